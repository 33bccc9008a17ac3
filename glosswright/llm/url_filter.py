"""URL filters: pattern rules behind an index of their rarest literal token.

Every rule has literal tokens (runs of ASCII letters and digits) that a URL it fits
must hold as tokens. The rule is filed under the one that fewest URLs hold. A URL's
own tokens fetch candidate rules from the index, and only those run their regular
expression. The index is a constant of the plan, an array of buckets of rule lists,
bounded by BLOCK_RULES, so the filter is a projection: no shuffle, no join, no Python.

Rules: site rules (a host suffix and a path prefix; the longest wins), and behind
them the method's own pattern rules, which decide where no site rule fits.

Defined results: a null URL or one without `://` has an empty host and path, fits no
rule and is allowed. Rows map one to one, repeated ones too, and an empty table gives
none. Of several pattern rules an exception wins, then the longest name, then the last
by name. Long URLs are judged whole. Other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswright.llm._common import ascii_lower, materialize


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str  # over host + path, A-Z lower-cased but for site rules; a host has no slash
    tokens: tuple[str, ...]  # a fitting URL holds each of them, lower-cased
    rank: int  # 2 for site rules, which outrank all others, 1 for exceptions


# The site rules.
SITES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Words that mark a host label or path segment as unwanted, by topic.
UNWANTED = {
    "spam": ("spam", "farm", "clickbait", "linkfarm"),
    "pharmacy": ("pills", "viagra", "cialis", "pharma"),
    "gambling": ("casino", "poker", "betting", "slots", "jackpot"),
    "adult": ("porn", "xxx", "escort"),
    "malware": ("warez", "keygen", "cracked", "torrent"),
    "money": ("payday", "forex", "giveaway"),
}


def _tokens(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall(r"[0-9a-z]+", text.lower())))


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the path starts with path."""
    # only whole tokens of the path are certain: its last run may go on in the URL
    whole = re.match(r"(?s)(.*[^0-9A-Za-z])?", path).group()
    regex = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return Rule(f"{host}{path}", verdict, regex, _tokens(host) + _tokens(whole), 2)


def word_rule(topic: str, word: str) -> Rule:
    """Blocks URLs that have word as a whole token."""
    return Rule(f"{topic}:{word}", "block", rf"(?s)(?:^|[^0-9a-z]){word}(?:[^0-9a-z]|\z)", (word,), 0)


# Pattern rules by topic, as filter lists write them. `*` stands for anything, `^` for
# a character that isn't one of a word or the end, `||` for a host's start or the place behind a dot
# of it, `|` for an end of the address. `@@` allows what other patterns block.
PATTERNS = """
# ads
/ads/  /ad/  /adserver/  /adserv/  /advert/  /adverts/  /advertising/  /banner/  /banners/  /bannerads/  /popunder/  /popup/  /sponsor/  /sponsored/
||ads.  ||ad.  ||adserver.  ||adclick.  ||banners.  ||doubleclick^  ||adnxs^  ||taboola^  ||outbrain^  ||criteo^  /ad-*/click^  /ads.js|  /ads.txt|  /pagead/*
# tracking
/track/  /tracking/  /tracker/  /pixel/  /beacon/  /collect/*  /analytics/*  /telemetry/  /stats/hit^  /piwik.php|  /matomo.php|  ||tracking.  ||pixel.  ||metrics.  ||analytics.  /utm/*  /click/redirect^
# account
/login/  /login|  /signin/  /signin|  /signup/  /register/  /logout/  /password/reset^  /account/settings^  /user/login^  /users/sign_in^  /oauth/authorize^  /sso/*  ||login.  ||accounts.  ||auth.
# shop
/cart/  /cart|  /checkout/  /basket/  /wishlist/  /add-to-cart^  /product/*/reviews/  /shop/*/sale/  /coupon/  /coupons/  /affiliate/  ||shop.*/cart^  /order/track^
# admin
/wp-admin/*  /wp-login.php|  /wp-json/*  /xmlrpc.php|  /cgi-bin/*  /phpmyadmin/  /administrator/  /admin/  /.git/*  /.env|  /server-status|  /backup/*.sql|  ||cpanel.  ||webmail.
# download
/setup.exe|  .exe|  .msi|  .apk|  .dmg|  .iso|  .torrent|  .rar|  /keygen/*  /crack/*  /serial-key^  /nulled/  /warez/*  ||torrents.  ||download.*/free^
# feeds
/feed/  /feed|  /rss/  /rss.xml|  /atom.xml|  /sitemap.xml|  /sitemap_index.xml|  /robots.txt|  /api/v1/*  /api/v2/*  /api/v3/*  /graphql|  /swagger/
# noise
/tag/*  /tags/*  /calendar/*  /archive/*/page/  /print/*  /share/*  /search/*  /forum/*/reply^  /forum/memberlist^  /wiki/special:*  /wiki/user_talk:*  /comment/reply^  /404.html|  /test/lorem^
# media
.jpg|  .jpeg|  .png|  .gif|  .webp|  .svg|  .mp3|  .mp4|  .avi|  .mov|  .zip|  .css|  .woff2|
# gambling
/slots/  /roulette/  /blackjack/  /sportsbook/  /bookmaker/  ||casino.  ||poker.  ||bet.  /free-spins^  /live-casino^
# adult
/nsfw/  /xxx/*  ||porn.  ||xxx.  ||adult.  /webcam-girls^  /hookup^
# pharmacy
/viagra/  /cialis/  /buy-pills^  /online-pharmacy^  ||pharmacy.  /weight-loss-pills^
# money
/payday-loan^  /payday-loans^  /get-rich^  /crypto-giveaway^  /binary-options^  ||forex.  /make-money-fast^
# spam
/link-farm^  /seo-links^  /guest-post^  /buy-backlinks^  /doorway/  /essay-writing-service^
# kept
@@/admin/docs/*  @@/archive/news/*  @@||archive.*/tag/  @@/search/help^  @@/login/help^
"""


def pattern_rule(topic: str, pattern: str) -> Rule:
    """A rule from one filter pattern; ValueError if it has no whole token to file it by."""
    body = pattern.removeprefix("@@")
    host, start = body.startswith("||"), body.startswith("|")
    end = body.endswith("|")
    core = body.lstrip("|").removesuffix("|").lower()
    # an end that isn't anchored may be followed by anything anyhow
    core = core if start else core.lstrip("*")
    core = core if end else core.rstrip("*")
    regex = {"*": ".*", "^": r"(?:[^0-9a-z_.%-]|\z)"}
    text = "".join(regex.get(c) or re.escape(c) for c in core)
    lead = r"^(?:[^/]*\.)?" if host else "^" if start else ""
    # a run of letters and digits is a whole token if nothing can go on beside it
    edge = "^" if start else "*"
    runs = re.finditer(r"[0-9a-z]+", core)
    around = f"{edge}{core}{'^' if end else '*'}"
    tokens = tuple(dict.fromkeys(m[0] for m in runs if around[m.start()] != "*" and around[m.end() + 1] != "*"))
    if not tokens:
        raise ValueError(f"pattern {pattern!r} has no whole token")
    allow = pattern.startswith("@@")
    return Rule(f"{topic}:{pattern}", "allow" if allow else "block", f"(?s){lead}{text}" + (r"\z" if end else ""), tokens, int(allow))


def load_patterns(text: str) -> tuple[Rule, ...]:
    """Rules of a filter list: patterns by white space, topics in lines that begin with #."""
    out, topic = [], "pattern"
    for line in text.splitlines():
        if line.startswith("#"):
            topic = line[1:].strip()
        else:
            out += [pattern_rule(topic, p) for p in line.split()]
    return tuple(out)


SITE_RULES = tuple(site_rule(*s) for s in SITES)
METHOD_RULES = tuple(word_rule(t, w) for t, ws in UNWANTED.items() for w in ws) + load_patterns(PATTERNS)
RULES = SITE_RULES + METHOD_RULES
#: Rules whose index stands in one plan; longer lists are judged block by block.
BLOCK_RULES = 1000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(target: Column) -> Column:
    """The distinct tokens of host + path."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(target), F.lit("[0-9a-z]+"), F.lit(0)))


def token_counts(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> dict[str, int]:
    """In how many URLs each rule token occurs: one row for a rule token, over all pages."""
    known = sorted({t for r in rules for t in r.tokens})
    target = F.concat(host_of(F.col("url")), path_of(F.col("url")))
    rows = (
        pages.select(F.explode(tokens_of(target)).alias("token"))
        .filter(F.col("token").isin(known))
        .groupBy("token")
        .count()
    )
    return {t: 0 for t in known} | {r["token"]: r["count"] for r in rows.collect()}


def build_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> list[list[Rule]]:
    """Buckets by crc32 of each rule's rarest token; a power of two of them, at least two for a rule."""
    buckets: list[list[Rule]] = [[] for _ in range(2 << len(rules).bit_length())]
    for r in rules:
        if not r.tokens:
            raise ValueError(f"rule {r.name!r} has no literal token")
        rarest = min(r.tokens, key=lambda t: (counts.get(t, 0), t))
        buckets[zlib.crc32(rarest.encode()) % len(buckets)].append(r)
    return buckets


BEST = "struct<rank:int,size:int,name:string,verdict:string>"


def _literal(index: list[list[Rule]]) -> Column:
    """array<array<struct>> as a constant that Spark folds once."""
    kind = "array<array<struct<rank:int,size:int,name:string,verdict:string,regex:string>>>"
    rows = [
        F.array(*(F.struct(F.lit(r.rank).alias("rank"), F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex")) for r in b))
        if b
        else F.array().cast(kind[6:-1])
        for b in index
    ]
    return F.array(*rows).cast(kind)


def _best(index: list[list[Rule]]) -> Column:
    """The deciding rule of one index: sites first, then exceptions, then the longest name."""
    held = _literal(index)
    bucket = lambda t: F.get(held, F.pmod(F.crc32(t.cast("binary")), F.lit(len(index))).cast("int"))
    candidates = F.array_distinct(F.flatten(F.transform(F.col("tokens"), bucket)))
    fits = lambda r: F.rlike(F.when(r["rank"] == 2, F.col("target")).otherwise(F.col("low")), r["regex"])
    short = lambda r: F.struct(r["rank"].alias("rank"), r["size"].alias("size"), r["name"].alias("name"), r["verdict"].alias("verdict"))
    return F.array_max(F.transform(F.filter(candidates, fits), short)).cast(BEST)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, counts: dict[str, int] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and the name of the rule that decided.

    The index of up to BLOCK_RULES rules is a constant of the plan. More rules are
    judged block by block, and what a block decided is written before the next one.
    """
    counts = token_counts(pages, rules) if counts is None else counts
    df = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.lit(None).cast(BEST).alias("best"))
    for at in range(0, len(rules), BLOCK_RULES):
        df = materialize(df, "url-block") if at else df
        target = df.withColumn("target", F.concat("host", "path")).withColumn("low", ascii_lower(F.col("target")))
        found = target.withColumn("tokens", tokens_of(F.col("target"))).withColumn("found", _best(build_index(rules[at : at + BLOCK_RULES], counts)))
        better = F.array_max(F.array("best", "found"))  # nulls are passed over
        df = found.withColumn("best", better).select("page_id", "host", "path", "best")
    return df.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.rank") == 2, F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.col("best.name").alias("decided_by"),
    )


_CASES = "\n".join(f"  SELECT '{v}' AS v, '{h}' AS h, '{p}' AS p UNION ALL" for v, h, p in SITES).removesuffix(" UNION ALL")
_QUOTED = [[x.replace("'", "''") for x in (r.name, r.regex)] + [r.rank, r.verdict] for r in METHOD_RULES]
_NAMES = ", ".join(f"('{name}', '{regex}', {rank}, '{verdict}')" for name, regex, rank, verdict in _QUOTED)

ORACLE_SQL = f"""
WITH r AS (
{_CASES}
), w(name, regex, rank, verdict) AS (VALUES {_NAMES}), u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), f AS (
  SELECT page_id, max_by(v, length(h || p)) AS v, max_by(h || p, length(h || p)) AS rule
  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY page_id
), g AS (
  SELECT page_id, max_by(name, (rank, length(name), name)) AS name, max_by(verdict, (rank, length(name), name)) AS verdict FROM u JOIN w
  ON regexp_matches(host || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), regex) GROUP BY page_id
)
SELECT u.page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN v ELSE coalesce(g.verdict, 'allow') END AS verdict, coalesce(rule, g.name) AS decided_by
FROM u LEFT JOIN f ON f.page_id = u.page_id LEFT JOIN g ON g.page_id = u.page_id
"""
