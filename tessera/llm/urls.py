"""URL filter: pattern rules indexed by their rarest literal token.

Every rule is a regular expression with the literal tokens that any match must contain. The rule is
filed under the one of them that the fewest URLs have; a URL's own tokens fetch its candidate rules,
and only these run their expressions. All of it is DataFrame code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Up to so many rules (of a few hundred bytes each) the index is broadcast; beyond, it is shuffled.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    """``regex`` is searched in the place (host and path) or, where ``whole``, in the lowered URL.
    ``tokens``: runs of 0-9a-z that every match holds as whole tokens; none: always a candidate.
    Of the place rules that match, the longest ``name`` decides; of the others any one blocks."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...] = field(default=())
    whole: bool = False


def place_rule(verdict: str, place: str) -> Rule:
    """A rule for a host with its subdomains and the paths that start with the given one, such as
    ``example.org/es/``."""
    host, slash, path = place.partition("/")
    path = slash + path
    # a token at the end of the path may go on in the URL, all others are whole
    tokens = re.findall(r"[0-9a-z]+", host.lower()) + re.findall(r"[0-9a-z]+(?=[^0-9a-z])", path.lower())
    return Rule(place, verdict, rf"^([^/]*\.)?\Q{host}{path}\E", tuple(tokens))


def pattern_rule(name: str, regex: str, *tokens: str) -> Rule:
    return Rule(name, "block", regex, tokens, whole=True)


#: The places to allow and to block.
PLACE_RULES = [
    place_rule("allow", "org/"),
    place_rule("block", "example.org/es/"),
    place_rule("block", "example.org/en/1"),
    place_rule("allow", "com/fr/"),
    place_rule("block", "com/de/"),
]
#: What is blocked elsewhere (advertising, adult and gambling words, session links).
PATTERN_RULES = [
    pattern_rule("advertising path", r"[/.]ads[/.]", "ads"),
    pattern_rule("advertising server", r"[/.]adserver[/.]", "adserver"),
    pattern_rule("banner path", r"/banners/", "banners"),
    pattern_rule("adult", r"(^|[^0-9a-z])porn([^0-9a-z]|$)", "porn"),
    pattern_rule("adult cams", r"(^|[^0-9a-z])sex[^0-9a-z]cams?([^0-9a-z]|$)", "sex"),
    pattern_rule("gambling", r"(^|[^0-9a-z])casino([^0-9a-z]|$)", "casino"),
    pattern_rule("session", r"[?&]phpsessid=", "phpsessid"),
    pattern_rule("session", r";jsessionid=", "jsessionid"),
    pattern_rule("log-in page", r"/login([/?#]|$)", "login"),
    pattern_rule("shop cart", r"/cart/checkout([/?#]|$)", "cart", "checkout"),
]


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    return lowered(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct runs of 0-9a-z of the lowered URL; the empty token stands for rules without literals."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(lowered(url), "[^0-9a-z]+")))


def _rules(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [F.struct(F.lit(n).alias("n"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("rule_verdict"), F.lit(r.regex).alias("regex"),
                     F.lit(r.whole).alias("whole"), F.array(*[F.lit(t) for t in r.tokens or ("",)]).alias("literals")) for n, r in enumerate(rules)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _small(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return F.broadcast(df) if len(rules) <= BROADCAST_RULES else df


def rule_index(spark: SparkSession, urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(token, n, name, rule_verdict, regex, whole)``: each rule under its rarest literal among all
    ``urls(url)``, ties by the token's text. Only literals of rules are counted."""
    table = _rules(spark, rules)
    literals = table.select(F.explode("literals").alias("token")).distinct()
    seen = urls.select(F.explode(tokens(F.col("url"))).alias("token")).join(_small(literals, rules), "token").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    filed = table.select("*", F.explode("literals").alias("token")).join(seen, "token", "left")
    rarest = F.min_by(F.col("token"), F.struct(F.coalesce("urls", F.lit(0)), "token"))
    return filed.groupBy("n").agg(rarest.alias("token"), *[F.first(c).alias(c) for c in ("name", "rule_verdict", "regex", "whole")])


def judge(spark: SparkSession, pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: list[Rule] | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for each row of ``pages``.

    The longest matching place rule decides; without one (``rule`` null) a matching pattern rule
    blocks and all else is allowed. A URL that is null or has no ``://`` has empty host and path and
    can only meet pattern rules. Each distinct URL is judged once; repeated rows all get its verdict;
    an empty table gives an empty result; other columns are not read.
    """
    rules = PLACE_RULES + PATTERN_RULES if rules is None else rules
    if not rules:
        raise ValueError("no rules")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    urls = rows.select("url").where("url is not null").distinct()
    index = rule_index(spark, urls, rules)
    host, path = host_and_path(F.col("url"))
    candidates = urls.select("url", F.concat(host, path).alias("place"), F.explode(tokens(F.col("url"))).alias("token")).join(_small(index, rules), "token")
    subject = F.when(F.col("whole"), lowered(F.col("url"))).otherwise(F.col("place"))
    hits = candidates.where(F.regexp_like(subject, F.col("regex")))
    longest = F.when(~F.col("whole"), F.struct(F.length("name").alias("size"), "name", "rule_verdict"))
    found = hits.groupBy("url").agg(F.max(longest).alias("place_rule"), F.max("whole").alias("blocked"))
    verdict = F.coalesce("place_rule.rule_verdict", F.when(F.col("blocked"), "block"), F.lit("allow"))
    return rows.join(found, "url", "left").select("page_id", host.alias("host"), path.alias("path"), F.col("place_rule.name").alias("rule"), verdict.alias("verdict"))
