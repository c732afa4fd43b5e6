"""URL filters: allow and block rules, then naive Bayes over hosts cut into words by a unigram Viterbi.

Word counts come from the text of all pages. A host label that runs words together is cut where the product of word
probabilities is largest. The classes of naive Bayes are learned from the urls that a rule decides, all of them, and judge the
others. Urls with one host and one path up to numbers share a signature, and everything is computed once per signature.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import attach, query, short_batches, staged, table, without

#: Letters in a word at most; words that a task counts before it passes the counts on.
LONGEST, HELD = 20, 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HIDDEN = re.compile(rb"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; rules are (verdict, host/path), a list as short as people write it.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of rules of one length the one with the
    longer host wins, then the first by name.
    """
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"), [-ord(c) for c in r[1]])):
        of, _, below = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + below)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def unigrams(pages: DataFrame, html: str = "html") -> DataFrame:
    """word, n: how often each word of a-z, up to LONGEST letters, stands in the text of the pages."""
    short_batches(pages.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        counts: Counter = Counter()

        def sent():
            yield from pa.Table.from_pydict({"word": [w.decode() for w in counts], "n": list(counts.values())}, schema) \
                .to_batches(max_chunksize=10000)
            counts.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                shown = _HIDDEN.sub(b" ", text).lower()
                counts.update(w for w in re.findall(rb"[a-z]+", shown) if len(w) <= LONGEST)
                if len(counts) > HELD:
                    yield from sent()
        yield from sent()

    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    return pages.select(body.alias("html")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The words of a label with the largest product of probabilities; an unknown word of k letters has 10 / (total 10^k).

    Of equal products the one with the shorter last word wins, and so on to the front.
    """
    best, last = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1)
    total = max(total, 1)
    for end in range(1, len(label) + 1):
        for start in range(end - 1, max(-1, end - LONGEST - 1), -1):
            n = counts.get(label[start:end])
            p = math.log(n / total) if n else math.log(10 / total) - (end - start) * math.log(10)
            if best[start] + p > best[end]:
                best[end], last[end] = best[start] + p, start
    words, end = [], len(label)
    while end:
        words.append(label[last[end]:end])
        end = last[end]
    return words[::-1]


def segment(labels: DataFrame, words: DataFrame) -> DataFrame:
    """label, words (array) for distinct labels of letters. Only counts of substrings of a label reach its task."""
    total = words.agg(F.sum("n")).first()[0] or 0
    starts = F.sequence(F.lit(1), F.length("label"))
    parts = labels.where("label <> ''").select("label", F.explode(starts).alias("at")).select(
        "label", F.explode(F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("label") - F.col("at") + 1)),
            lambda n: F.substring(F.col("label"), F.col("at"), n)))).alias("word")).distinct()
    known = parts.join(words, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.udf("array<string>")
    def cut(label, known):
        return viterbi(label, {r["word"]: r["n"] for r in known or ()}, total)

    return labels.where("label <> ''").join(known, "label", "left").select("label", cut("label", "known").alias("words"))


def _host_tokens(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """host, host_tokens: words of its labels, in order, with 0 for a number."""
    bits = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(r"[a-z]+|[^a-z.\-_]+"), F.lit(0)))
                        .alias("at", "label"))
    cuts = staged(segment(bits.where(F.col("label").rlike("^[a-z]+$")).select("label").distinct(), words))
    pieces = bits.join(cuts, "label", "left").withColumn(
        "words", F.coalesce("words", F.array(F.regexp_replace("label", r"[0-9]+", "0"))))
    in_order = F.array_sort(F.collect_list(F.struct("at", "words")))  # the labels of one host
    return hosts.join(pieces.groupBy("host").agg(in_order.alias("parts")), "host", "left").select(
        "host", F.coalesce(F.transform(F.flatten(F.transform("parts", lambda p: p["words"])),
                                       lambda w: F.concat(F.lit("host:"), w)), F.array().cast("array<string>"))
        .alias("host_tokens"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], words: DataFrame, url: str = "url") -> DataFrame:
    """The pages with host, path, rule, verdict and ``block_odds``, the log odds of naive Bayes for block.

    Urls that no rule decides are blocked if the odds are above 0. Without decided urls of a class its counts are 0, smoothed
    by one; tokens that no decided url has count as often in either class as the smoothing says. Null urls and urls without
    ``://`` have an empty host and path. Columns of the input with names of the result are replaced.
    """
    made = ["host", "path", "rule", "verdict", "block_odds"]
    host, path = host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`"))
    rest = without(pages, [c for c in made if c != url])
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    known = rest.withColumns({"_host": host, "_path": path}).withColumns(
        {"_shape": F.regexp_replace(F.translate("_path", _UPPER, _LOWER), "[0-9]+", "0"), "_rule": rule, "_verdict": verdict})
    shapes = staged(known.groupBy(F.col("_host").alias("host"), F.col("_shape").alias("shape"),
                                  F.col("_verdict").alias("verdict")).agg(F.count("*").alias("urls")))
    hosts = staged(shapes.groupBy("host").agg(F.count("*").alias("shapes")))
    cut = staged(_host_tokens(hosts.select("host"), words).join(hosts, "host"))
    path_tokens = F.transform(F.filter(F.split("shape", r"[^\p{L}\p{N}]+", -1), lambda t: t != ""),
                              lambda t: F.concat(F.lit("path:"), t))
    tokens = staged(attach(shapes, cut, ["host"], "shapes").select(
        "host", "shape", "verdict", "urls", F.concat("host_tokens", path_tokens).alias("tokens")))
    each = tokens.select("host", "shape", "verdict", "urls", F.explode("tokens").alias("token"))
    of = {v: F.sum(F.when(F.col("verdict") == v, F.col("urls")).otherwise(F.lit(0))) for v in ("allow", "block")}
    model = staged(each.groupBy("token").agg(of["allow"].alias("allow"), of["block"].alias("block"),
                                             F.count("*").alias("rows")))
    size = model.agg(F.sum("allow"), F.sum("block"), F.count("*")).first()
    urls = shapes.agg(of["allow"], of["block"]).first()
    allow, block, kinds = (x or 0 for x in size)
    prior = math.log(((urls[1] or 0) + 1) / ((urls[0] or 0) + 1))
    odds = F.log((F.col("block") + 1) / F.lit(float(block + kinds))) - F.log((F.col("allow") + 1) / F.lit(float(allow + kinds)))
    scored = attach(each.where("verdict IS NULL"), model, ["token"], "rows").groupBy("host", "shape") \
        .agg(F.sum(F.round(odds, 9).cast("decimal(20,9)")).alias("odds"))  # exact sums do not hang on their order
    found = staged(shapes.groupBy("host", "shape").agg(F.sum("urls").alias("urls")).join(scored, ["host", "shape"], "left")
                   .select(F.col("host").alias("_host"), F.col("shape").alias("_shape"), "urls",
                           (F.coalesce(F.col("odds").cast("double"), F.lit(0.0)) + F.lit(prior)).alias("_odds")))
    judged = attach(known, found, ["_host", "_shape"], "urls")
    by_odds = F.when(F.col("_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(*[F.col(f"`{c}`") for c in rest.columns if c.lower() not in made], F.col("_host").alias("host"), F.col("_path").alias("path"),
                         F.col("_rule").alias("rule"), F.coalesce("_verdict", by_odds).alias("verdict"),
                         F.when(F.col("_verdict").isNull(), F.col("_odds")).alias("block_odds"))


#: The rules of the registered query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/")]


@query("op10_url_filter")
def op10(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    words = staged(unigrams(pages))
    return judge(pages.select("page_id", "url"), RULES, words)\
        .select("page_id", "host", "path", "rule", "verdict", "block_odds")
