"""Quality rules with host verdicts, in DataFrame functions only.

Each document gets rule counts and a base verdict. Failures of each rule are summed by host; a host's rates are shrunk by a
beta prior for each rule that is fitted to the hosts themselves; a host is rejected if the shrunk rate of any rule reaches
REJECT_RATE, and its verdict is joined back to its documents.

Defined cases: null text counts as empty (no words, so the base rules fail); a null source is no host, and only the base
rules decide; an empty table gives an empty table; repeated rows count each; a very long text is one row's arrays of words and
windows, in one task; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WIDE_ROWS, WORD, WS, lookup, materialise, packed, unpacked

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A host is rejected when its shrunk failure rate is at least this; high, so that clean pages of mixed hosts stay.
REJECT_RATE = 0.8
#: Bounds of the prior's strength (in documents), also used where the hosts show no variance.
PRIOR_MIN, PRIOR_MAX = 2.0, 1000.0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rules that are summed by host, as SQL on the counts. The first two are the base rules, which also decide on a document itself.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "same_lines": "5 * n_dup_lines > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}


def _bind(value: Column, use) -> Column:
    """use(value) with value evaluated once a row: a lambda variable stands for it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(hashes: Column) -> Column:
    """Words under windows whose hash occurs twice or more: sort the windows, keep equal neighbours, sum up the cover."""

    def cover(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def repeated(s: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))  # noqa: E731  get() is null outside
        return F.sort_array(F.transform(F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"]))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = _bind(pairs, repeated)
    return _bind(at, cover)


def _repeat_words(words: Column) -> Column:
    windows = _bind(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW))))
    counted = _bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))
    return F.when(F.size(words) > WINDOW, counted).otherwise(F.lit(0).cast("long"))


def counts(text: Column) -> dict[str, Column]:
    """The counts of one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WS, "")) > 0)
    both = lambda words: F.struct(F.size(words).cast("long").alias("n"), _repeat_words(words).alias("repeat"))
    return {
        "_words": _bind(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), both),
        "word_chars": F.length(F.translate(text, WS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": _bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


def rule_columns(docs: DataFrame) -> DataFrame:
    """docs has text and columns of other names than these -> also n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    base_failed."""
    counted = docs.withColumns(counts(F.col("text"))).withColumns({"n_words": F.col("_words.n"), "n_repeat_words": F.col("_words.repeat")})
    return counted.drop("_words").withColumn("base_failed", F.expr(f"({RULES['few_words']}) OR ({RULES['repeats']})"))


def host_verdicts(judged: DataFrame, host: str = "source") -> DataFrame:
    """One row a host: n, the failures and the shrunk rate of each rule, and host_kept; judged has the host column and the counts."""
    fails = [F.sum(F.expr(f"({rule})").cast("long")).alias(f"failed_{name}") for name, rule in RULES.items()]
    hosts = materialise(judged.filter(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n"), *fails), "host-failures")
    moments = []
    for name in RULES:
        moments += [F.sum(f"failed_{name}") / F.sum("n"), F.var_pop(F.col(f"failed_{name}") / F.col("n"))]
    of = hosts.agg(*[m.alias(f"m{i}") for i, m in enumerate(moments)]).first()
    rejected = F.lit(False)
    for i, name in enumerate(RULES):
        mean, var = of[2 * i], of[2 * i + 1]
        strength = min(PRIOR_MAX, max(PRIOR_MIN, mean * (1 - mean) / var - 1)) if mean is not None and var else PRIOR_MAX
        alpha = (mean or 0.0) * strength
        hosts = hosts.withColumn(f"rate_{name}", (F.col(f"failed_{name}") + F.lit(alpha)) / (F.col("n") + F.lit(float(strength))))
        rejected |= F.col(f"rate_{name}") >= REJECT_RATE
    return hosts.withColumn("host_kept", ~rejected)


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the rule columns, base_failed, and kept. Only narrow columns leave the scan."""
    light = materialise(rule_columns(docs.select("doc_id", F.col(host).alias("host"), "text")).select("doc_id", "host", *COUNTS, "base_failed"), "rule-counts")
    verdicts = host_verdicts(light, "host").select("host", "n", "host_kept")
    joined = lookup(light, verdicts, "host", "n")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).drop("host_kept").withColumnRenamed("host", host)


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that pass, with their own columns. The rules are computed once: texts that pass them are written with their
    counts, of the others the counts only."""
    apart = packed(docs, "text")
    inner = apart.select("text", "row", F.col(f"row.c{[c for c in docs.columns if c != 'text'].index(host)}").alias("host"))
    ruled = rule_columns(inner)
    kept = lambda c: F.when(~F.col("base_failed"), F.col(c)).alias(c)
    judged = materialise(ruled.select("host", *COUNTS, "base_failed", kept("text"), kept("row")), "ruled")
    rejected = host_verdicts(judged.select("host", *COUNTS), "host").filter(~F.col("host_kept")).select("host", "n", F.lit(True).alias("host_failed"))
    good = judged.filter(~F.col("base_failed")).select("host", "text", "row")
    if not rejected.isEmpty():
        good = lookup(good, rejected, "host", "n", WIDE_ROWS).filter(F.col("host_failed").isNull())
    return good.select(*unpacked(docs.columns, "text"))
