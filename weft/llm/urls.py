"""URL filters: pattern rules behind an index on their rarest literal token.

A rule is a pattern in the usual block-list notation: ``||`` at the start binds
to a host or any of its subdomains, ``*`` stands for any text, ``^`` for one
separator or the end, everything else for itself. Each rule is filed under one
token, the one of its complete literal tokens that the judged URLs contain
least often. A URL's own tokens fetch the rules filed under them, and only those
rules run their regular expression. All of it is DataFrame functions.

Nulls and odd input: a null URL, or one without ``://``, has an empty host and
path, fits no rule and gets the default verdict. Repeated rows are judged alike;
of rules that tie in all else the larger pattern wins. An empty table, and an empty
list of rules, are fine; URLs of any length are read whole. Input columns host, path,
rule and verdict are replaced; all others are kept whatever their names, as rows
travel packed.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.batches import named as column

#: Up to so many rules live in the plan as literals; beyond, rules are joined by token.
INLINE_RULES = 256


@dataclass(frozen=True)
class Rule:
    """``name`` is what the result shows; the largest (``rank``, length of name, name) among the fitting rules wins."""

    name: str
    pattern: str
    verdict: str
    rank: int = 0

    def regex(self) -> str:
        """Java and RE2 both read it; it runs on host + rest of the URL, the host in lower case."""
        anchored = self.pattern.startswith("||")
        body = self.pattern[2:] if anchored else self.pattern
        made = "".join(
            ".*" if c == "*" else "(?:[^A-Za-z0-9_.%-]|$)" if c == "^" else re.sub(r"([^A-Za-z0-9_/])", r"\\\1", c)
            for c in body
        )
        return r"^(?:[^/?#]*\.)?" + made if anchored else "(?i)" + made

    def tokens(self) -> list[str]:
        """Literal tokens that every fitting URL has as whole tokens: bounded on both sides inside the pattern."""
        anchored = self.pattern.startswith("||")
        body = self.pattern[2:] if anchored else self.pattern
        found = []
        for m in re.finditer(r"[A-Za-z0-9]+", body):
            left_open = m.start() == 0 and not anchored or m.start() > 0 and body[m.start() - 1] == "*"
            right_open = m.end() == len(body) or body[m.end()] == "*"
            if not left_open and not right_open:
                found.append(m[0].lower())
        return sorted(set(found))


def host_rule(host_path: str, verdict: str, rank: int = 1) -> Rule:
    """A rule like ``example.org/es/``: the host with its subdomains, and a prefix of the path."""
    return Rule(host_path, "||" + host_path, verdict, rank)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or end; A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to the next ``?``, ``#`` or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _target(url: Column) -> Column:
    """What the regular expressions read: the host and all that follows it; null if the URL has no host part."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), rest))


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.split(F.lower(target), "[^a-z0-9]+"))


def rarest_tokens(urls: DataFrame, rules: Sequence[Rule], url_col: str = "url") -> dict[str, list[int]]:
    """Token -> positions of the rules filed under it.

    The counts come from all the URLs, but only of tokens that rules hold, so
    what reaches the driver is bounded by the rules. Rules without a complete
    token are filed under the empty string, which every URL fetches.
    """
    known = sorted({t for r in rules for t in r.tokens()})
    if not known:
        return {"": list(range(len(rules)))}
    spark = urls.sparkSession
    seen = urls.select(F.explode(_tokens(_target(F.col(url_col)))).alias("token"))
    wanted = spark.createDataFrame([(t,) for t in known], "token string")
    counts = dict(seen.join(F.broadcast(wanted), "token").groupBy("token").count().collect()) if known else {}
    filed: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        own = min(r.tokens(), key=lambda t: (counts.get(t, 0), t), default="")
        filed.setdefault(own, []).append(k)
    return filed


def _table(rules: Sequence[Rule]) -> Column:
    """The rules as an array of (rank, length, name, verdict, regex)."""
    return F.array(
        *[
            F.struct(
                F.lit(r.rank).alias("rank"),
                F.lit(len(r.name)).alias("length"),
                F.lit(r.name).alias("name"),
                F.lit(r.verdict).alias("verdict"),
                F.lit(r.regex()).alias("regex"),
            )
            for r in rules
        ]
    )


def _best(rules: Column) -> Column:
    """Of an array of rules the one that wins among those that fit ``target``."""
    return F.array_max(F.filter(rules, lambda r: F.rlike(F.col("target"), r["regex"])))


def _inline(urls: DataFrame, rules: Sequence[Rule], filed: dict[str, list[int]]) -> DataFrame:
    """(url, row) with the winning rule."""
    keys = sorted(filed)
    index = F.map_from_arrays(
        F.array(*[F.lit(k) for k in keys]),
        F.array(*[F.array(*[F.lit(i) for i in filed[k]]) for k in keys]),
    )
    table = _table(rules)
    fetched = F.flatten(
        F.filter(
            F.transform(F.array_distinct(F.concat(F.col("tokens"), F.array(F.lit("")))), lambda t: F.try_element_at(index, t)),
            lambda x: x.isNotNull(),
        )
    )
    with_tokens = urls.withColumn("target", _target(F.col("url"))).withColumn("tokens", F.coalesce(_tokens(F.col("target")), F.array().cast("array<string>")))
    return with_tokens.select("url", "row", _best(F.transform(fetched, lambda i: F.get(table, i))).alias("won"))


def _joined(urls: DataFrame, rules: Sequence[Rule], filed: dict[str, list[int]]) -> DataFrame:
    """For large rule sets: distinct URLs meet the rules by token, and what wins returns by URL.

    Rules without a token would meet every URL under one key, so they are read beside.
    """
    spark: SparkSession = urls.sparkSession
    index = spark.createDataFrame(
        [(t, r.rank, len(r.name), r.name, r.verdict, r.regex()) for t, found in filed.items() if t for r in (rules[i] for i in found)],
        "token string, rank int, length int, name string, verdict string, regex string",
    )
    distinct = urls.filter(F.col("url").isNotNull()).select(F.col("url").alias("asked")).distinct().withColumn("target", _target(F.col("asked")))
    asked = distinct.select("asked", "target", F.explode(_tokens(F.col("target"))).alias("token"))
    fits = asked.join(index, "token").filter(F.rlike("target", F.col("regex")))
    won = fits.groupBy("asked").agg(F.max(F.struct("rank", "length", "name", "verdict", "regex")).alias("won"))
    met = urls.join(won, urls["url"] == won["asked"], "left").withColumn("target", _target(F.col("url")))
    always = [rules[i] for i in filed.get("", [])]
    best = F.array_max(F.array_compact(F.array("won", _best(_table(always))))) if always else F.col("won")
    return met.select("url", "row", best.alias("won"))


def filter_urls(urls: DataFrame, rules: Sequence[Rule], default: str = "allow", url_col: str = "url") -> DataFrame:
    """``urls`` with host, path, rule (the name of the winning rule or null) and verdict."""
    if not rules:
        filed, judge = {}, None
    else:
        filed = rarest_tokens(urls, rules, url_col)
        judge = _inline if len(rules) <= INLINE_RULES else _joined
    packed = urls.select(F.col(url_col).alias("url"), F.struct(*map(column, urls.columns)).alias("row"))
    won = judge(packed, rules, filed) if judge else packed.withColumn("won", F.lit(None).cast("struct<name: string, verdict: string>"))
    return won.select(
        *[F.col("row").getField(c).alias(c) for c in urls.columns if c not in ("host", "path", "rule", "verdict")],
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("won.name").alias("rule"),
        F.coalesce(F.col("won.verdict"), F.lit(default)).alias("verdict"),
    )
