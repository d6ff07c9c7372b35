"""Quality rules with host-level enforcement, in DataFrame functions only.

Every document gets the rule figures of :func:`measures`. Two rules are absolute (too short, too
repetitive). The softer rules of ``HOST_RULES`` are noisy for one document, so they are enforced
per host: failures are counted by host, the rate of each host is shrunk towards all hosts with a
beta prior whose strength is fitted by moments, and where the shrunk rate of a rule exceeds
``max_rate`` the host's documents that break this rule are rejected. A document that breaks no rule
is kept on any host.

Defined cases: null text has no words (so it fails); a null doc_id is kept as it is; a null host is a host of its own;
repeated rows are judged one by one; a rate of exactly ``max_rate`` is not enforced; very long texts are read whole, as
one row's arrays; an empty table gives no rows; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut

SYMBOLS = "#*$%&|<>"
WINDOW = 8
BROADCAST_BYTES = 8_000_000  # of hosts on which a rule is enforced
SALTS = 64  # keys over which a host's documents are dealt if these hosts are more
#: name -> breaks the rule, over the columns of measures().
HOST_RULES = {
    "symbols": "10 * n_symbols > word_chars",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "repeats": "10 * n_repeat_words > n_words",
    "brief": "n_words < 40",
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def measures(text: Column) -> Column:
    """A struct of the rule figures of a text. Windows are told apart by hash first; only texts in which
    two window hashes agree compare the windows' own words."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: without(x, SPACES) != "")
    return bound(F.struct(text.alias("t"), words.alias("w"), lines.alias("l")), _figures)


def _figures(x: Column) -> Column:
    n = F.size(x.w)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    words = F.transform(x.w, lambda w: F.xxhash64(w))
    hashes = bound(words, lambda h: F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))))
    return F.struct(
        n.cast("long").alias("n_words"),
        F.length(without(x.t, SPACES)).cast("long").alias("word_chars"),
        (F.length(x.t) - F.length(without(x.t, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size(x.l) - F.size(F.array_distinct(x.l))).cast("long").alias("n_dup_lines"),
        bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(x.w, h)).otherwise(F.lit(0))).cast("long").alias("n_repeat_words"),
        F.size(x.l).cast("long").alias("n_lines"),
    )


def _covered(words: Column, hashes: Column) -> Column:
    """Words that lie in a window which stands at two or more places."""
    window = lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(WINDOW)))
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), window(i).alias("s"), i.alias("i"))))
    same = lambda p, q: F.coalesce((p.h == q.h) & (p.s == q.s), F.lit(False))
    again = bound(placed, lambda a: F.filter(a, lambda p, k: same(p, F.get(a, k - 1)) | same(p, F.get(a, k + 1))))
    starts = F.array_sort(F.transform(again, lambda p: p.i))
    return F.aggregate(starts, F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("at"), (a.n + F.least(i - a.at, F.lit(WINDOW))).alias("n")), lambda a: a.n)


def host_rates(judged: DataFrame) -> DataFrame:
    """Per host and rule the shrunk failure rate: columns host, rule, n, failed, rate.

    The prior of a rule: mean m = failures / documents; variance between hosts = weighted variance of the
    raw rates less its binomial part m(1-m)H/N; strength m(1-m)/variance - 1, held within 1 and 1e6.
    """
    counts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f"breaks.{r}").cast("long")).alias(r) for r in HOST_RULES))
    long = counts.select("host", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in HOST_RULES))).alias("x")).select("host", "n", "x.rule", "x.failed")
    m, n = F.col("m"), F.col("n")
    prior = (
        long.groupBy("rule")
        .agg(F.sum("failed").alias("f"), F.sum("n").alias("N"), F.count(F.lit(1)).alias("H"), F.sum(F.col("failed") * F.col("failed") / n).alias("ff"))
        .withColumn("m", F.col("f") / F.col("N"))
        .withColumn("between", F.greatest(F.col("ff") / F.col("N") - m * m - m * (1 - m) * F.col("H") / F.col("N"), F.lit(1e-12)))
        .select("rule", "m", F.least(F.greatest(m * (1 - m) / F.col("between") - 1, F.lit(1.0)), F.lit(1e6)).alias("k"))
    )
    return long.join(prior, "rule").select("host", "rule", "n", "failed", ((F.col("failed") + m * F.col("k")) / (n + F.col("k"))).alias("rate"))


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of the documents (doc_id if unset) with the figures, base_failed and kept."""
    keep = ["doc_id"] if keep is None else keep
    m = F.col("q")
    figures = docs.select(F.struct(*keep).alias("own"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.isnull(host_col).alias("no_host"), measures(F.col(text_col)).alias("q"))
    judged = figures.select(
        "own", F.struct("no_host", "host").alias("host"), "q",
        ((m.n_words < 20) | (100 * m.n_repeat_words > 30 * m.n_words)).alias("base_failed"),
        F.struct(*(F.expr(_over(rule)).alias(name) for name, rule in HOST_RULES.items())).alias("breaks"),
    )
    judged = cut(judged)
    enforced = cut(host_rates(judged).where(F.col("rate") > max_rate).groupBy("host").agg(F.collect_set("rule").alias("enforced")))
    rejected = F.coalesce(F.exists(F.array(*(F.when(F.col(f"breaks.{r}"), F.lit(r)) for r in HOST_RULES)), lambda r: F.array_contains(F.col("enforced"), r)), F.lit(False))
    return with_verdicts(judged, enforced).select("own.*", *(f"q.{c}" for c in MEASURES[:5]), "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))


def with_verdicts(judged: DataFrame, enforced: DataFrame, most_bytes: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """Documents with the rules that are enforced on their host, if any. Only hosts with an enforced rule stand in that
    table; while their names fit ``most_bytes`` it is broadcast, so documents stay where they are. Beyond that each host's
    documents are dealt over ``salts`` keys, so that a host with a third of all documents is not one task's."""
    if enforced.agg(F.coalesce(F.sum(F.octet_length("host.host") + 64), F.lit(0))).first()[0] <= most_bytes:
        return judged.join(F.broadcast(enforced), "host", "left")
    dealt = judged.withColumn("salt", F.pmod(F.xxhash64("own", "q"), F.lit(salts)))
    return dealt.join(enforced.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))), ["host", "salt"], "left")


def _over(rule: str) -> str:
    for c in MEASURES:
        rule = rule.replace(c, f"q.{c}") if c != "n_words" else rule.replace("n_words", "q.n_words")
    return rule


ORACLE = r"""
with t as (select doc_id, coalesce(source, '') as host, source is null as no_host, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
wins as (select doc_id, i, array_to_string(words[i:i+7], ' ') as win from w, unnest(range(1, len(words) - 6)) as u(i) where len(words) >= 8),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from wins) where n > 1),
cov as (select doc_id, count(distinct i + k) as n from rep, unnest(range(0, 8)) as u(k) group by doc_id),
f as (select w.doc_id, host, no_host, len(words)::bigint as n_words, coalesce(length(array_to_string(words, '')), 0)::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, len(lines) as n_lines
  from w left join cov on w.doc_id = cov.doc_id),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  10 * n_symbols > word_chars as r1, 10 * n_dup_lines > 3 * n_lines as r2, 10 * n_repeat_words > n_words as r3, n_words < 40 as r4 from f),
h as (select host, no_host, count(*) as n, unnest(['a', 'b', 'c', 'd']) as rule, unnest([sum(r1::int), sum(r2::int), sum(r3::int), sum(r4::int)])::double as failed from b group by host, no_host),
p0 as (select rule, sum(failed) / sum(n) as m, sum(n)::double as nn, count(*) as hh, sum(failed * failed / n) as ff from h group by rule),
p as (select rule, m, least(greatest(m * (1 - m) / greatest(ff / nn - m * m - m * (1 - m) * hh / nn, 1e-12) - 1, 1.0), 1e6) as k from p0),
e as (select host, no_host, bool_or(rule = 'a') as e1, bool_or(rule = 'b') as e2, bool_or(rule = 'c') as e3, bool_or(rule = 'd') as e4
  from h join p using (rule) where (failed + m * k) / (n + k) > 0.5 group by host, no_host)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(e1 and r1 or e2 and r2 or e3 and r3 or e4 and r4, false) as kept
from b left join e on b.host = e.host and b.no_host = e.no_host
"""
