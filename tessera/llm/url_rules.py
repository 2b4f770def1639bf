"""URL filters: rules of a list first, then association rules mined from labels.

A URL becomes a set of tokens, one per slot (host, subdomain, domain, first and
second folder, ending, query keys, fragment, scheme). Spark's FP-growth mines
the token sets that go with a label; rules with enough support and confidence,
surely above the label's share of all URLs, that no shorter rule makes needless
are kept. An inverted index, each rule under its rarest token, matches them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_side, written

ALLOW, BLOCK = "allow", "block"
LABELS = {0: "label allow", 1: "label block"}
#: Share of the labelled URLs that a rule must fit together with its label, and how often it must be right.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
#: Labelled URLs that a rule must fit together with its label, and standard errors by which its confidence must lie above
#: the label's share of all URLs: of many thousand candidate rules some are far above it by chance.
LEAST, ERRORS = 10, 4.0
LABEL_BYTES = 64 << 20


@dataclass(frozen=True)
class HostRule:
    """A host with all subdomains and the start of a path; the longest rule that fits decides."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TokenRule:
    """Tokens that go with a label."""

    tokens: frozenset[str]
    blocks: bool
    confidence: float
    support: float

    @property
    def order(self) -> tuple:
        """Of the rules that fit, the largest decides: surest, best supported, then shortest, then by its text."""
        return (self.confidence, self.support, -len(self.tokens), sorted(self.tokens), self.blocks)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; empty without it."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """One token per slot that a URL has, at most nine, so that mining can't blow up."""
    host, path, rest = host_of(url), path_of(url), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1)
    labels = F.split(host, r"\.")
    folders = F.filter(F.split(path, "/"), lambda part: part != "")
    named = F.transform(folders, lambda part: F.regexp_replace(part, r"^[0-9]+", "0"))
    query = F.regexp_extract(rest, r"(?s)^\?([^#]*)", 1)
    keys = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(query, "&"), lambda pair: F.split(pair, "=")[0]))), ",")
    slots = {
        "scheme": lower_ascii(F.regexp_extract(url, r"(?s)^(.*?)://", 1)),
        "host": host,
        "first": F.get(labels, F.lit(0)),
        "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
        "folder": F.get(named, F.lit(0)),
        "second": F.get(named, F.lit(1)),
        "ending": F.regexp_extract(path, r"(?s)(/|\.[A-Za-z0-9]{1,8})$", 1),
        "query": keys,
        "fragment": F.regexp_extract(rest, r"(?s)#(.+)$", 1),
    }
    made = [F.when(F.length(value) > 0, F.concat(F.lit(f"{name} "), value)) for name, value in slots.items()]
    return F.array_distinct(F.array_compact(F.array(*made)))


def mine(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, least: int = LEAST, errors: float = ERRORS
) -> list[TokenRule]:
    """Rules from (url, bad): every labelled URL counts, repeated ones as often as they come.

    A rule stays if the lower end of its confidence interval (Wilson's, of so
    many standard errors) is above the share of its label in all URLs. A URL has
    at most nine tokens, so at most 512 / min_support rules reach the driver,
    whatever the corpus. No labelled URL gives no rule.
    """
    rows = labelled.where("url is not null and bad is not null")
    bad = F.col("bad") == 1
    items = written(rows.select(F.array_append(tokens_of(F.col("url")), F.when(bad, F.lit(LABELS[1])).otherwise(F.lit(LABELS[0]))).alias("items")))
    n, n_bad = items.select(F.count(F.lit(1)), F.count_if(F.array_contains("items", LABELS[1]))).first()
    if not n:
        return []
    parts = max(1, int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, least / n)), numPartitions=parts).fit(items)
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))
    # only sets with a label make a rule: its tokens are the rest of the set, whose count is another row
    label = F.when(F.array_contains("items", LABELS[1]), F.lit(LABELS[1])).when(F.array_contains("items", LABELS[0]), F.lit(LABELS[0]))
    sets = written(sets.withColumn("label", label))
    rules = sets.where("label is not null and size(items) > 1").select(F.array_remove("items", F.col("label")).alias("items"), F.col("n").alias("right"), (F.col("label") == LABELS[1]).alias("blocks"))
    found = rules.join(sets.where("label is null").select("items", "n"), "items")
    found = found.select("items", "blocks", (F.col("right") / F.col("n")).alias("confidence"), (F.col("right") / n).alias("support"), "n")
    share = F.when(F.col("blocks"), n_bad / n).otherwise(1 - n_bad / n)
    sure = found.where((F.col("confidence") >= min_confidence) & (lower_end(F.col("confidence"), F.col("n"), errors) > share + 1e-12))
    rules = [TokenRule(frozenset(r["items"]), r["blocks"], round(r["confidence"], 12), round(r["support"], 12)) for r in sure.collect()]
    return pruned(rules)


def lower_end(share: Column, n: Column, errors: float) -> Column:
    """Lower end of Wilson's interval of a share of n."""
    z = errors * errors
    return (share + z / (2 * n) - errors * F.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)


def pruned(rules: Sequence[TokenRule]) -> list[TokenRule]:
    """Without the rules that a rule of fewer of their tokens, as sure at least, makes needless."""
    by_tokens: dict[frozenset[str], list[TokenRule]] = {}
    for rule in rules:
        by_tokens.setdefault(rule.tokens, []).append(rule)
    kept = []
    for rule in sorted(rules, key=lambda r: (len(r.tokens), r.order)):
        tokens = sorted(rule.tokens)
        smaller = (frozenset(t for i, t in enumerate(tokens) if bits >> i & 1) for bits in range(1, (1 << len(tokens)) - 1))
        if not any(other.confidence >= rule.confidence for some in smaller for other in by_tokens.get(some, ())):
            kept.append(rule)
    return kept


class Index:
    """Rules under their rarest token."""

    def __init__(self, rules: Sequence[TokenRule]) -> None:
        often: dict[str, int] = {}
        for rule in rules:
            for token in rule.tokens:
                often[token] = often.get(token, 0) + 1
        self.under: dict[str, list[TokenRule]] = {}
        for rule in sorted(rules, key=lambda r: r.order, reverse=True):
            self.under.setdefault(min(rule.tokens, key=lambda t: (often[t], t)), []).append(rule)

    def best(self, tokens: set[str]) -> TokenRule | None:
        found = [rule for token in tokens for rule in self.under.get(token, ()) if rule.tokens <= tokens]
        return max(found, key=lambda r: r.order, default=None)


def _listed(rules: Sequence[HostRule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule of the list that fits (host, path), else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # later, longer ones come to stand outside
        fits = ((F.col("host") == rule.host) | F.col("host").endswith(f".{rule.host}")) & F.col("path").startswith(rule.path)
        text, verdict = F.when(fits, F.lit(rule.text)).otherwise(text), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def judge(pages: DataFrame, rules: Sequence[HostRule], mined: Sequence[TokenRule], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence) for every row of pages.

    The list's rule decides; where none fits, the best mined rule; where none
    does either, the page is allowed. A null url, or one without ://, has an
    empty host and path. Very long URLs are read whole. Repeated rows are judged
    alike; no row is shuffled. An empty table gives an empty one; other columns
    of pages, whatever their names, have no effect.
    """
    text = pages[url].cast("string")
    rows = pages.select(pages[page_id].alias("page_id"), host_of(text).alias("host"), path_of(text).alias("path"), F.coalesce(tokens_of(text), F.array().cast("array<string>")).alias("tokens"))
    chosen, verdict = _listed(rules)
    rows = rows.select("page_id", "host", "path", "tokens", chosen.alias("rule"), verdict.alias("listed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(mined)
        for batch in batches:
            best = [index.best(set(tokens or ())) for tokens in batch.column("tokens").to_pylist()]
            listed = batch.column("listed").to_pylist()
            found = [of or (BLOCK if rule and rule.blocks else ALLOW) for of, rule in zip(listed, best, strict=True)]
            columns = [batch.column(x) for x in ("page_id", "host", "path", "rule")]
            columns += [pa.array(found, pa.string()), pa.array([" & ".join(sorted(r.tokens)) if r else None for r in best], pa.string())]
            columns += [pa.array([r.confidence if r else None for r in best], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict", "mined", "confidence"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, mined string, confidence double")


def labelled_urls(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """(url, bad) of the pages whose url ends in the number of a labelled document; bad is 1 for poor or toxic ones."""
    number = F.try_to_number(F.regexp_extract(path_of(pages[url]), r"/([0-9]{1,18})[^/0-9]*/?$", 1), F.lit("9" * 18)).cast("long")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("number"))
    known = known.agg(F.max(F.greatest(1 - F.col("quality"), F.col("toxic"))).alias("bad"))
    return pages.select(pages[url].alias("url"), number.alias("number")).join(small_side(known, LABEL_BYTES, 24), "number").select("url", "bad")
