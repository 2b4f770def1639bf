import zlib

from pyspark.sql import functions as F

from tessera.llm import toxicity
from tessera.llm.toxicity import Model, Scorer, grammar


def read(symbols):
    return "".join(grammar().best(list(symbols))[0])


def weight(symbols):
    return grammar().best(list(symbols))[1]


def test_grammar_tells_events():
    assert read("O1O") == "OiO"
    assert read("YO1") == "YOa" and read("2OY") == "aOY"  # aimed, before or after
    assert read("2OOOY") == "aOOOY" and read("2OOOOY") == "iOOOOY"  # a target reaches over four words
    assert read("NO1") == "NOd"  # denied
    assert read("NOOO1") == "NOOOi"  # beyond the reach of the negator
    assert read("ROO3") == "ROOq"  # quoted
    assert read("TOY") == "TOt" and read("YT") == "Yt"  # a threat once it has a target
    assert read("TOO") == "TOO" and read("NTY")[1] == "d" and read("RTY")[1] == "q"


def test_arcs_weigh_what_they_match():
    assert any(w for arcs in grammar().arcs.values() for _, _, w in arcs)
    for level, odds in toxicity.LEVELS.items():
        assert weight(f"O{level}O") == odds and weight(f"YO{level}") == weight(f"{level}OY") == 1.5 * odds
        assert weight(f"RO{level}") == 0 and weight(f"NO{level}") < 0
    assert weight("1O2") == 7.5 and weight("1O2Y") == 1.5 * 7.5 and weight("TOY") == toxicity.THREAT_WEIGHT and weight("TOO") == 0
    assert weight("2OOOOOOO") == 4.5  # a promise that isn't kept is never the best path


def test_best_path_equals_the_best_of_all_paths():
    import random

    r, g = random.Random(3), grammar()
    for _ in range(300):
        symbols = [r.choice("123TYNRO") for _ in range(r.randint(1, 7))]
        paths = [(0.0, g.start)]
        for symbol in symbols:
            paths = [(total + w, to) for total, state in paths for to, _, w in g.step(state, symbol)]
        assert g.best(symbols)[1] == max(total for total, _ in paths)


def test_composition_equals_one_after_the_other():
    import itertools

    from tessera.llm.transducer import Transducer

    one, two = Transducer(0), Transducer("s")
    one.add(0, "a", 1, "b", 1.0)
    one.add(0, "a", 0, "c", 0.5)
    one.add(1, "ab", 0, None, 2.0)
    two.add("s", "b", "t", "x", 0.25)
    two.add("t", "bc", "s", "y", 1.0)
    both = one.compose(two, "ab")
    for word in itertools.product("ab", repeat=4):
        best = None
        paths = [(0.0, 0, "s", ())]
        for symbol in word:
            after = []
            for total, mine, its, out in paths:
                for to, middle, weight in one.step(mine, symbol):
                    for end, last, more in two.step(its, middle):
                        after.append((total + weight + more, to, end, (*out, last)))
            paths = after
        best = max(p[0] for p in paths)
        assert abs(both.best(word)[1] - best) < 1e-12
        assert (best, both.best(word)[0]) in [(p[0], list(p[3])) for p in paths]


def test_scorer_weighs_words_and_stems():
    scorer = Scorer(Model({"idiot": 5.0, "blarstan": 3.5}, {"blar": 6.5, "blarst": 4.6}))
    assert [scorer.lexical(w) for w in ("idiot", "idio", "idiots", "blar", "blarf", "blarst", "blarsto", "blarstan", "you", "", "é")] == list("2OOO3331YOO")
    assert scorer.events("You are an idiot. Blarfing!") == [1.5 * 4.5 + 6.0, 1.0, 1.0, 0.0, 0.0, 0.0]
    assert scorer.events("I will kill you") == [3.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    assert scorer.events(None) == scorer.events("") == scorer.events("fine words") == [0.0] * 6


def test_denied_and_quoted_never_raise_a_score():
    scorer, model = Scorer(Model({"idiot": 5.0}, {})), Model({}, {}, 2.0, -3.0)
    said = {text: model.total(scorer.events(text)[0]) for text in ("", "an idiot came", "you are an idiot", "no, not an idiot", "she said an idiot came", "the idiot is you")}
    nothing, plain, aimed, denied, quoted, after = said.values()
    assert aimed == after > plain > quoted and denied <= nothing and quoted <= nothing
    for text in ("an idiot came. ", "you idiot! ", "fine. "):
        assert all(scorer.events(text + more)[0] <= scorer.events(text)[0] for more in ("not an idiot", "he wrote idiot", "never kill you"))


def test_very_long_text_is_read_whole():
    scorer = Scorer(Model({"idiot": 5.0}, {}))
    assert scorer.events("word " * 200_000 + ". you idiot")[0] == 1.5 * 4.5


def test_held_out_accuracy_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.score(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out and toxic is not null").select("toxic", "predicted", "score").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    wrong = [r.predicted for r in rows if r.toxic == 0]
    assert len(caught) > 20 and sum(caught) / len(caught) > 0.9 and sum(wrong) / len(wrong) < 0.01
    assert scored.count() == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_held_out_rows_are_by_checksum_and_never_learned_from(spark):
    ids = spark.range(200).select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in ids)
    texts = [(i, f"plain words {'zorgful rant' if i % 3 == 0 else 'stand here'}") for i in range(100)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(100)], "doc_id long, toxic int")
    held = {i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0}
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id").isin(list(held)), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.score(docs, flipped).collect()}
    assert a == b


def test_edge_cases(spark, edge_docs):
    docs = edge_docs([None, "", "you utter zorg", "zorg! zorg?", "nice day"] * 8)
    labels = spark.createDataFrame([(i, int(i % 5 in (2, 3))) for i in range(40)] + [(None, 1), (3, None), (3, 1)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(rows) == 40 and rows[0].score == rows[1].score and rows[0].predicted == 0
    nothing = toxicity.score(docs, labels.limit(0)).collect()
    assert len(nothing) == 40 and {r.predicted for r in nothing} == {0}
    assert toxicity.score(docs.limit(0), labels).count() == 0
    kept = toxicity.drop_toxic(docs.union(docs), labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i, r in rows.items() if not r.predicted] * 2)
    binary = toxicity.drop_toxic(docs.withColumn("text", F.col("text").cast("binary")), labels)
    assert binary.schema["text"].dataType.simpleString() == "binary" and binary.count() == len(kept.collect()) / 2
