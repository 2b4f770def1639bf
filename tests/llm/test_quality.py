import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 20 or 100 * len(covered) > 30 * len(words),
    }


def histograms(text, lang):
    text = text or ""
    words = WORD.findall(text)
    signs = [len(re.findall(p, text)) for p in quality.CLASSES.values()]
    space = len(text) - sum(map(len, words))
    chars = [*signs, space, len(text) - space - sum(signs)]
    listed = quality.COMMON_WORDS.get(lang)
    if not listed:
        return chars, None
    forms = {x: w for w in listed for x in (w, w.capitalize())}
    hits = Counter(forms[w] for w in words if w in forms)
    return chars, [*(hits[w] for w in listed), len(words) - sum(hits.values())]


def distance(counts, shares):
    if not counts or not shares or not sum(counts):
        return None
    p = [c / sum(counts) for c in counts]
    total = 0
    for a, b in zip(p, shares, strict=True):
        total += (a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0)
    return math.sqrt(max(total / 2, 0))


def brute(rows):
    sums = defaultdict(lambda: [None, None])
    for r in rows:
        if r.lang in quality.COMMON_WORDS:
            for k, counts in enumerate(histograms(r.text, r.lang)):
                old = sums[r.lang][k]
                sums[r.lang][k] = counts if old is None else [a + b for a, b in zip(old, counts, strict=True)]
    shares = {lang: [[x / max(sum(c), 1) for x in c] for c in both] for lang, both in sums.items()}
    rules, out = quality.Rules(), {}
    for r in rows:
        found = base(r.text)
        counts = histograms(r.text, r.lang)
        chars, words = (distance(c, s) for c, s in zip(counts, shares.get(r.lang, (None, None)), strict=True))
        far = (found["n_words"] >= rules.min_words and words is not None and words > rules.most_word_distance) or (
            len(r.text or "") >= rules.min_chars and chars is not None and chars > rules.most_char_distance
        )
        out[r.doc_id] = {**found, "kept": not found["base_failed"] and not far, "char_distance": chars, "word_distance": words}
    return out


def check(frame, docs):
    want = brute(docs.collect())
    rows = frame.collect()
    assert len(rows) == docs.count()
    for r in rows:
        for name, value in want[r.doc_id].items():
            if isinstance(value, float):
                assert abs(r[name] - value) < 1e-9, (r.doc_id, name)
            else:
                assert r[name] == value, (r.doc_id, name)


def test_whole_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(quality.judge(docs), docs)


def test_edge_cases(spark, edge_docs):
    repeated = " ".join(["a b c d e f g h i j"] * 5)
    texts = [None, "", "\x0b\x0c \r\n\t", "one two \x1c three", repeated, "x " * 40, "line\nline\n \nline", "the end " * 3 + "é" * 3000, "# $ % & | < > *" * 30]
    docs = edge_docs(texts + ["plain words"] * 3, ["en", None, "xx", "de", "fr", "es", "en", "en", "de", "en", "xx", None])
    check(quality.judge(docs), docs)
    assert quality.judge(docs.limit(0)).count() == 0


def test_keep_good_agrees_with_judge_and_returns_rows_as_they_are(spark, edge_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in quality.judge(docs).where("kept").collect())
    odd = edge_docs([None, "of the people by the people " * 10])
    assert quality.keep_good(odd.union(odd)).count() == 2 * quality.judge(odd).where("kept").count()
    assert quality.keep_good(odd.limit(0)).count() == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.judge(docs).join(labels, "doc_id").where("not base_failed")
    good = judged.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    poor = judged.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.99 and poor < 0.7


def test_no_python_in_the_plan(spark):
    plan = quality.keep_good(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
