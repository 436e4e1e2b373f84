"""URL filters: host and path rules, then logistic regression on hashed character n-grams.

The classifier is fitted on the small labelled table below (or a table that the caller
gives). Everything after that is one projection over the urls: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashed_logistic import HashedLogistic, fit, grams

BUCKETS = 8192
SIZES = (3, 4, 5)
REGULARISATION = 0.002

#: Rules of the registered query: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: The labelled table: words that tell unwanted pages, and words of ordinary ones, in host or path.
_BLOCKED = """
casino poker slots jackpot roulette blackjack baccarat gambling betting sportsbets bookmaker wager bingo lottery-winner
viagra cialis pills cheap-meds steroids diet-pills buy-tablets porn xxx adult-video sexcam escorts nude-pics hookup milf
warez keygen cracked-apps serial-keys nulled free-torrents pirated phishing verify-account confirm-login malware trojan
spam bulk-mail link-farm backlinks clickbait adserver ads ad-network banner-ads popunder tracking-pixel tracker
payday-loans quick-cash get-rich easy-money forex-signals crypto-doubler replica-watches fake-bags miracle-cure
claim-prize free-iphone win-prize free-spins bonus-code
"""
_ALLOWED = """
library museum university school college kindergarten city-hall council parliament ministry court embassy weather
garden cooking recipes bakery farm winery maths physics biology chemistry astronomy geology linguistics history archive
news daily herald journal magazine gazette radio theatre music choir opera cinema bookshop publisher poetry essays
statistics open-data standards railway timetable airport harbour ferry hiking cycling football tennis chess birds forest
river mountain island hospital dentist nursing pharmacist software docs developer compiler database forum blog diary
travel hostel adults-learning therapist assistance advice classics passport export betterment pillow windmill trackside
scrapbook spring-fair address adventure
"""
#: What stands around these words in both classes alike.
_TOPS = ("com", "net", "org", "info", "io", "de", "fr", "co.uk")
_PLAIN = ("site", "web", "home", "portal", "page", "main", "world", "place")
_PATHS = ("", "/", "/en/123", "/de/48.html", "/fr/77?page=2", "/es/900/", "/index.html", "/a/2021/05")
_BEFORE = ("", "www.", "m.", "shop.")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: url, label. Each word stands alone in a host, beside another word in a host, and
    in the path of a host that tells nothing; all else rotates over both labels."""
    rows = []
    for label, names in (("block", _BLOCKED.split()), ("allow", _ALLOWED.split())):
        for k, name in enumerate(names):
            top, plain, path, before = _TOPS[k % 8], _PLAIN[k // 2 % 8], _PATHS[k // 3 % 8], _BEFORE[k % 4]
            rows.append(f"{label} https://{before}{name}.{top}{path}")
            rows.append(f"{label} http://{plain}-{name}.{_TOPS[(k + 3) % 8]}{_PATHS[(k + 5) % 8]}")
            rows.append(f"{label} https://{before}{plain}.{_TOPS[(k + 5) % 8]}/{'en' if k % 2 else plain}/{name}{('', '/', '-1', '.html')[k // 4 % 4]}")
    lines = spark.range(1).select(F.explode(F.split(F.lit("\n".join(rows)), "\n")).alias("_line"))
    return lines.select(F.split("_line", " ")[1].alias("url"), F.split("_line", " ")[0].alias("label"))


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, with A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to '?', '#' or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def features(host: Column, path: Column) -> Column:
    """Marked character n-grams of host and path; the labels of the host are bounded by dots, a path by its end."""
    h, p = F.concat(F.lit("."), host, F.lit(".")), F.concat(F.lower(path), F.lit("$"))
    return F.concat(*[grams(h, n, f"h{n}:") for n in SIZES], *[grams(p, n, f"p{n}:") for n in SIZES])


def fit_url_model(labelled: DataFrame) -> HashedLogistic:
    """labelled: url, label ('block' or 'allow'); a table of a few hundred rows."""
    rows = labelled.select(features(host_of(F.col("url")), path_of(F.col("url"))).alias("features"), "label")
    return fit(rows, ["allow", "block"], BUCKETS, REGULARISATION)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null. Ties in length: the first given."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [
        F.when(
            ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2]),
            F.struct(F.lit(r[0]).alias("verdict"), F.lit(r[1] + r[2]).alias("rule")),
        )
        for r in ranked
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<verdict:string,rule:string>")


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    model: HashedLogistic | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    threshold: float = 0.5,
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score.

    * a null url, an empty one or one without '://' has an empty host and path; no rule fits it,
      so the method decides, on next to nothing.
    * repeated rows and null ids pass through; an empty table gives an empty result; other
      columns are ignored; very long urls are judged whole.
    """
    model = model or fit_url_model(labelled_urls(pages.sparkSession))
    url = F.col(url_col).cast("string")
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = parts.select(
        "page_id", "host", "path",
        matching_rule(F.col("host"), F.col("path"), rules).alias("_rule"),
        model.probability(features(F.col("host"), F.col("path"))).alias("score"),
    )
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), own).alias("verdict"),
        "score",
    )
