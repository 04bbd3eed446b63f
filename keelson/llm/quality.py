"""Quality rules with host-level verdicts.

Per document, rules are counted with array expressions on the whole text. Failures are aggregated by host, each
host's failure rate is shrunk towards the corpus rate by a beta prior whose strength is estimated from the spread of
the host rates, and the host's verdict is joined back to its documents: documents of a host of which nearly all
documents fail go too, also those that pass by themselves.

The rules are few_words and repeated (together: base_failed), symbolic (symbols to word characters) and duplicated
(repeated lines to lines). Each has a shrunk rate by host. A document is kept if it does not fail base_failed, no rate of
its host reaches HOST_REJECT_RATE, and its own share of symbols and of repeated lines is within the limit times (1 - the
host's rate): the more of a host fails a rule, the less is let pass there, and a document without symbols or repeated
lines passes on any host that is not rejected.

Everything is a DataFrame expression. Repeated 8-word windows are found inside the row: word hashes are combined by
doubling (1, 2, 4, 8 words) into 64-bit window hashes; only documents with an equal pair sort their windows. The
n_repeat_words count takes equal 64-bit hashes as equal windows.

Defined results: a null text has no words (all counts 0, fails), an empty table gives an empty result, repeated rows
count as often as they occur, a null host is a host of its own, a very long text is counted whole within its row, a share
equal to its limit passes, other columns of the input are ignored unless ``carry`` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, SPACE, group_key, hinted, materialize, text_or_empty, words

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Symbols to word characters, and repeated lines to lines with a word; tightened by the host's rate.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 10, 30
WINDOW = 8
#: A host is rejected when its shrunk failure rate reaches this share.
HOST_REJECT_RATE = 0.8
#: Bounds of the prior's strength, in documents.
PRIOR_MIN, PRIOR_MAX = 2.0, 10_000.0
SYMBOLS = "#*$%&|<>"


def _pair_hash(a: Column, step: int) -> Column:
    """Hash of a[i] and a[i + step]; entries past the end mix in nothing and are cut by the caller."""
    return F.zip_with(a, F.slice(a, F.lit(step + 1), F.greatest(F.size(a), F.lit(1))), lambda x, y: F.xxhash64(x, y))


def _repeat_words(windows: Column) -> Column:
    """Number of words covered by windows whose hash occurs at least twice."""
    none = F.lit(False)
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    following = F.slice(pairs, F.lit(2), F.size(pairs))
    same_next = F.zip_with(pairs, following, lambda a, b: F.coalesce(a["h"] == b["h"], none))
    same_prev = F.concat(F.array(none), F.slice(same_next, F.lit(1), F.size(pairs) - 1))
    marked = F.zip_with(pairs, F.zip_with(same_next, same_prev, lambda a, b: a | b),
                        lambda p, m: F.when(m, p["i"]))
    starts = F.sort_array(F.filter(marked, lambda i: i.isNotNull()))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(starts, start, lambda s, i: F.struct(
        (s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n"), (i + WINDOW).alias("end")))["n"]


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                   carry: list[str] | None = None) -> DataFrame:
    """(id, host key, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words[, row], the rules)."""
    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    x = docs.select(F.col(id_col).alias("id"), group_key(host_col).alias("host"), text_or_empty(text_col).alias("t"), *row)
    keep = ["id", "host"] + (["row"] if carry else [])
    has_word = r"[^\x20\x09-\x0D]"
    lines = F.filter(F.split(F.col("t"), "\n"), lambda s: s.rlike(has_word))
    x = x.select(*keep, words(F.col("t")).alias("w"), lines.alias("lines"), F.length("t").alias("n_chars"),
                 F.length(F.translate("t", SPACE, "")).cast("bigint").alias("word_chars"),
                 F.length(F.translate("t", SYMBOLS, "")).alias("unsymbolic"))
    x = x.select(*keep, F.size("w").cast("bigint").alias("n_words"), "word_chars",
                 (F.col("n_chars") - F.col("unsymbolic")).cast("bigint").alias("n_symbols"),
                 F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
                 F.transform("w", lambda s: F.xxhash64(s)).alias("h"))
    done = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    for step in (1, 2, 4):
        x = x.select(*keep, *done, _pair_hash(F.col("h"), step).alias("h"))
    x = x.select(*keep, *done, F.slice("h", F.lit(1), F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))).alias("h"))
    x = x.select(*keep, *done, "h", (F.size(F.array_distinct("h")) < F.size("h")).alias("repeats"))
    x = x.select(*keep, *done, F.when(F.col("repeats"), _repeat_words(F.col("h"))).otherwise(0)
                 .cast("bigint").alias("n_repeat_words"))
    few = F.col("n_words") < MIN_WORDS
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return x.withColumns({"few_words": few, "repeated": repeats, "base_failed": few | repeats, **{r: over_limit(r) for r in LIMITS}})


#: Rules with a limit: (what is counted, of what, limit in percent).
LIMITS = {"symbolic": ("n_symbols", "word_chars", MAX_SYMBOL_PERCENT), "duplicated": ("n_dup_lines", "n_lines", MAX_DUP_LINE_PERCENT)}


def over_limit(rule: str, share: Column | None = None) -> Column:
    """Whether a document is above the rule's limit, or ``share`` of that limit."""
    part, whole, percent = LIMITS[rule]
    limit = percent * F.col(whole)
    return 100 * F.col(part) > (limit if share is None else limit * share)


def host_verdicts(rules: DataFrame, reject_rate: float = HOST_REJECT_RATE) -> DataFrame:
    """(host, n, failures per rule, rate, rejected, and a rate of each limit): failure rates by host, shrunk by an
    empirical beta prior.

    The prior's mean is the corpus failure rate m; its strength is m (1 - m) / v - 1 for the variance v of the host
    rates (method of moments), within PRIOR_MIN and PRIOR_MAX. One row of totals comes to the driver."""
    names = {"base_failed": "rate", **{r: f"{r}_rate" for r in LIMITS}}
    hosts = rules.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("bigint")).alias(f"n_{c}") for c in ("few_words", "repeated", *names)])
    hosts = materialize(hosts, "quality-hosts")
    total, *spread = hosts.agg(F.sum("n"), *[f for c in names for f in (F.sum(f"n_{c}"), F.var_pop(F.col(f"n_{c}") / F.col("n")))]).first()
    rates = {}
    for (c, name), failed, var in zip(names.items(), spread[::2], spread[1::2]):
        mean = (failed or 0) / total if total else 0.0
        strength = PRIOR_MAX if not var else mean * (1 - mean) / var - 1
        strength = min(max(strength, PRIOR_MIN), PRIOR_MAX)
        rates[name] = (F.col(f"n_{c}") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumns(rates).withColumn("rejected", F.col("rate") >= reject_rate)


def apply_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  carry: list[str] | None = None, reject_rate: float = HOST_REJECT_RATE) -> DataFrame:
    """document_rules with the host's rates, ``host_rejected`` and the verdict ``kept``."""
    rules = materialize(document_rules(docs, id_col, text_col, host_col, carry), "quality-rules")
    hosts = host_verdicts(rules, reject_rate).select("host", F.col("rate").alias("host_rate"), F.col("rejected").alias("host_rejected"),
                                                     *[f"{r}_rate" for r in LIMITS])
    out = rules.join(hinted(hosts, "host"), "host")
    kept = ~F.col("base_failed") & ~F.col("host_rejected")
    for rule in LIMITS:
        rate = F.col(f"{rule}_rate")
        kept = kept & (rate < reject_rate) & ~over_limit(rule, 1 - rate)
    return out.withColumn("kept", kept)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply_quality(docs).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                      "n_repeat_words", "base_failed", "kept")


def stage_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that all rules and their host's verdict accept, with the input's columns."""
    return apply_quality(docs, carry=docs.columns).filter("kept").select("row.*")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
e AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS win
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM e) WHERE c > 1),
n AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
      FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
b AS (
  SELECT d.doc_id, d.source, len(w.ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(l.n_lines, 0)::BIGINT AS n_lines, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN l USING (rid) LEFT JOIN n USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             100 * n_symbols > 10 * word_chars AS symbolic, 100 * n_dup_lines > 30 * n_lines AS duplicated FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad, count(*) FILTER (symbolic) AS sym,
             count(*) FILTER (duplicated) AS dup FROM f GROUP BY source),
m AS (SELECT sum(bad) / sum(n) AS bm, var_pop(bad / n) AS bv, sum(sym) / sum(n) AS sm, var_pop(sym / n) AS sv,
             sum(dup) / sum(n) AS dm, var_pop(dup / n) AS dv FROM h),
p AS (SELECT bm, sm, dm,
        CASE WHEN bv IS NULL OR bv = 0 THEN 10000.0 ELSE least(greatest(bm * (1 - bm) / bv - 1, 2.0), 10000.0) END AS bk,
        CASE WHEN sv IS NULL OR sv = 0 THEN 10000.0 ELSE least(greatest(sm * (1 - sm) / sv - 1, 2.0), 10000.0) END AS sk,
        CASE WHEN dv IS NULL OR dv = 0 THEN 10000.0 ELSE least(greatest(dm * (1 - dm) / dv - 1, 2.0), 10000.0) END AS dk FROM m),
q AS (SELECT source, (bad + bm * bk) / (n + bk) AS rate, (sym + sm * sk) / (n + sk) AS s_rate, (dup + dm * dk) / (n + dk) AS d_rate FROM h, p)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate < 0.8 AND s_rate < 0.8 AND d_rate < 0.8
       AND NOT 100 * n_symbols > 10 * word_chars * (1 - s_rate) AND NOT 100 * n_dup_lines > 30 * n_lines * (1 - d_rate) AS kept
FROM f JOIN q ON f.source IS NOT DISTINCT FROM q.source
"""
