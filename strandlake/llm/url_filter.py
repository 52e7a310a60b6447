"""URL filters: rules by host and path, and for the rest a logistic regression on hashed character n-grams.

The model is fitted to a small labelled table of URLs and becomes one column
expression. Only DataFrame functions run on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.native import let, upto

# The rules (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Lengths of the n-grams, and weights that they are hashed to.
SIZES, BUCKETS = (3, 4, 5), 4096
#: A path counts for so much of what a host does.
PATH = 0.2
#: Endings that the labelled URLs take in turn in the place of ``example``, so that no ending tells anything.
ENDINGS = ("com", "org", "net", "info", "example.org")
#: Labelled URLs: what one would keep out of training data (betting, adult content, sold medicine and loans, advertisements, trackers, link farms, cracked software), and ordinary sites and paths.
BLOCKED = (
    "http://www.casino-royal.example/play", "https://online-casino.example/slots", "http://megacasino.example/en/7731.html", "https://casinos-best.example/de/402", "http://poker-stars.example/room", "https://play-poker.example/fr/2210?page=2",
    "http://slots-jackpot.example/spin", "https://jackpot-win.example/es/918/", "http://big-win.example/lottery", "https://bet-now.example/odds", "http://sports-bets.example/de/8120.html", "https://betting-tips.example/", "http://free-betting.example/en/3307",
    "https://adult-video.example/de/6120", "http://adults-only.example/en/661.html", "https://xxx-tube.example/porn", "http://porn-hub.example/videos", "https://sex-chat.example/en/1029#top", "http://hot-escort.example/es/77", "https://nude-pics.example/",
    "http://cheap-viagra.example/buy", "https://pills-online.example/order", "http://cheap-meds.example/pharmacy", "https://buy-pills.example/en/5150", "http://diet-pills.example/de/9003/", "https://replica-watches.example/cheap", "http://cheap-loans.example/payday", "https://payday-loan.example/en/24.html",
    "http://ads.example/banner", "https://ad-server.example/click", "http://ads-network.example/en/6014", "https://track-click.example/pixel", "http://tracker.example/es/4400/", "https://adserv.example/popup", "http://doubleclick-ads.example/fr/350.html", "https://click-track.example/redirect", "http://banner-ads.example/pop",
    "http://spam-links.example/de/12.html", "https://link-farm.example/seo", "http://seo-spam.example/backlinks", "https://farm-links.example/en/2718", "http://get-rich-quick.example/en/31", "https://free-money.example/win", "http://click-here-win.example/prize", "https://win-iphone.example/prize",
    "http://warez-crack.example/es/5555.html", "https://free-cracks.example/serial", "http://torrent-movies.example/download", "https://hacked-accounts.example/dump", "http://phishing-login.example/verify",
    "http://www.pornstar-clips.example/en/18", "https://m.sexcams.example/de/7", "http://pokerroom.example/fr/3", "https://poker-bonus.example/en/9", "http://casino-online-bonus.example/es/2", "https://blog.casinobonus.example/en/6",
    "http://m.slot-machines.example/en/44", "https://adult-dating.example/fr/12", "http://adult-x-movies.example/en/5", "https://www.adultshop.example/de/61", "http://link-spam.example/es/7", "https://spam-bots.example/en/8",
    "http://www.content-farm.example/en/71", "https://cheap-cialis.example/fr/6", "http://betting-odds.example/en/2", "https://m.bets-online.example/es/33", "http://loans-payday-cash.example/en/12", "https://ad-tracking.example/en/55",
    "http://ads-serve.example/de/17", "https://trackers-pixel.example/fr/9",
)
ALLOWED = (
    "https://www.library.example/catalogue", "http://news.example/politics/2021", "https://blog.gardening.example/roses", "https://en.encyclopedia.example/wiki/River", "http://university.example/research/papers", "https://museum.example/visit", "http://weather.example/forecast/today",
    "https://docs.project.example/guide/install", "http://m.cooking.example/recipes/bread", "https://forum.cycling.example/thread/421", "https://school.example/timetable", "http://hospital.example/departments/children", "https://city-council.example/minutes", "http://travel-notes.example/italy",
    "https://history.example/romans/roads", "http://math-lessons.example/algebra", "https://chess-club.example/games", "http://bird-watch.example/species/heron", "https://theatre.example/programme", "http://orchestra.example/concerts", "https://science-today.example/physics/light",
    "https://open-source.example/code/review", "http://language-school.example/es/grammar", "https://the-farm.example/cheese", "http://red-house.example/fr/article", "https://blue-sky.example/de/artikel", "https://m.thinker.example/en/1234", "http://www.northern.example/en/8812.html",
    "https://blog.thesea.example/de/553", "http://therein.example/fr/7754/", "https://thorn.example/es/190", "http://www.anther.example/en/4100?page=2", "https://tension.example/de/6621.html", "http://m.brother.example/es/9031#top", "https://nothing.example/fr/27",
    "https://data.statistics.example/tables/2020", "http://law-review.example/volume/12", "https://farmers.example/market", "http://railways.example/routes", "https://astronomy.example/planets/mars", "http://poetry.example/collected/spring", "https://housing.example/advice/rent",
    "https://garden-tools.example/reviews", "http://paper-mill.example/about", "https://winter-sports.example/skiing", "http://advice.example/contact", "https://addresses.example/lookup", "http://better-health.example/sleep", "https://railtrack.example/maps", "http://clicker-training.example/dogs",
    "http://www.harvest.example/en/18", "https://m.thandor.example/de/7", "http://thesting.example/fr/3", "https://ninth.example/en/9", "http://thenation.example/es/2", "https://blog.notion.example/en/6",
    "http://m.thatched-roofs.example/en/44", "https://stations.example/fr/12", "http://the-other-shore.example/en/5", "https://www.weatherthings.example/de/61", "http://thistle.example/es/7", "https://blacksmiths.example/en/8",
    "http://www.lighthouses.example/en/71", "https://healthand-garden.example/fr/6", "http://nationalparks.example/en/2", "https://m.threads.example/es/33", "http://wheat-fields.example/en/12", "https://bathing.example/en/55",
    "http://thousand-lakes.example/de/17", "https://earthworks.example/fr/9", "https://street-plans.example/de/8", "http://old-town.example/en/5",
)


@dataclass(frozen=True)
class Model:
    bias: float
    weights: tuple[float, ...]


def split(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: what follows the first ``://`` up to a slash, question mark or hash sign, with A-Z lower-cased, and what follows that up to a question mark or hash sign. Both are empty where there is no ``://``."""
    text = F.coalesce(url, F.lit(""))
    start = F.instr(text, "://")
    rest = F.when(start > 0, F.substring(text, start + 3, F.length(text))).otherwise(F.lit(""))
    before = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(before, "/", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.substring(before, F.length(host) + 1, F.length(before))


def _grams(text: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """Numbers of the buckets of all n-grams of a text."""

    def sized(chars: Column, n: int) -> Column:
        return F.transform(upto(F.size(chars) - (n - 1)), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))

    def of(chars: Column) -> Column:
        return F.flatten(F.array(*[sized(chars, n) for n in sizes]))

    return F.transform(let(F.array_remove(F.split(text, ""), ""), of), lambda g: (F.crc32(g.cast("binary")) % BUCKETS).cast("int"))


def features(host: Column, path: Column) -> Column:
    """Buckets of the n-grams of the host, between carets, and of the path, between blanks and with a 0 for each run of digits; each once in its part."""
    digits = F.regexp_replace(path, "[0-9]+", "0")
    return F.struct(*[F.array_distinct(_grams(F.concat(F.lit(edge), text, F.lit(edge)))).alias(name) for name, text, edge in (("host", host, "^"), ("path", digits, " "))])


def learn(rows: list[tuple[list[int], list[int], bool]], steps: int = 400, rate: float = 4.0, decay: float = 0.0003) -> Model:
    """Weights by gradient descent on the mean logistic loss of (host buckets, path buckets, blocked); the buckets of a part share its length, which is 1 or ``PATH``. No rows give a model of even odds."""
    weights, bias = [0.0] * BUCKETS, 0.0
    if not rows:
        return Model(bias, tuple(weights))
    parts = [([(b, size / math.sqrt(len(p))) for p, size in ((host, 1.0), (path, PATH)) for b in p], blocked) for host, path, blocked in rows]
    for _ in range(steps):
        gradient, shift = {}, 0.0
        for values, blocked in parts:
            z = bias + sum(weights[b] * v for b, v in values)
            miss = (1 / (1 + math.exp(-z)) - blocked) / len(rows)
            shift += miss
            for b, v in values:
                gradient[b] = gradient.get(b, 0.0) + miss * v
        bias -= rate * shift
        for b, g in gradient.items():
            weights[b] -= rate * (g + decay * weights[b])
    return Model(bias, tuple(weights))


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled table (url, blocked) that comes with the library."""
    rows = [F.struct(F.lit(u.replace(".example/", f".{ENDINGS[k % len(ENDINGS)]}/")).alias("url"), F.lit(b).alias("blocked")) for urls, b in ((BLOCKED, True), (ALLOWED, False)) for k, u in enumerate(urls)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def fit(table: DataFrame, rows: int = 2000, url_col: str = "url", label_col: str = "blocked") -> Model:
    """The model of at most ``rows`` labelled URLs, those with the smallest hashes; null URLs and labels teach nothing, and repeated rows count once."""
    host, path = split(F.col(url_col))
    known = table.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(url_col).alias("url"), F.col(label_col).cast("boolean").alias("blocked"), host.alias("host"), path.alias("path")).distinct()
    got = known.select(F.xxhash64("url").alias("_hash"), "url", "blocked", features(F.col("host"), F.col("path")).alias("buckets")).orderBy("_hash", "url", "blocked").limit(rows).collect()
    return learn([(r["buckets"]["host"], r["buckets"]["path"], r["blocked"]) for r in got])


def probability(model: Model, host: Column, path: Column) -> Column:
    """How likely the model finds a URL to be one to block."""
    table = F.array(*[F.lit(w) for w in model.weights]) if any(model.weights) else None

    def of(buckets: Column) -> Column:
        total = F.lit(model.bias)
        for name, size in (("host", 1.0), ("path", PATH)) if table is not None else ():
            part = F.aggregate(buckets[name], F.lit(0.0), lambda s, b: s + F.get(table, b))
            total += size * F.coalesce(F.try_divide(part, F.sqrt(F.size(buckets[name]))), F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    return let(features(host, path), of)


def rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host, its domain or a domain above it, and the beginning of the path, as text, and its verdict; null where none fits. Rules of one length are taken in their order."""
    text = verdict = F.lit(None).cast("string")
    for kind, domain, start in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        text, verdict = F.when(fits, F.lit(domain + start)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def judge(pages: DataFrame, model: Model | None, rules: tuple = RULES, least: float = 0.6, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, probability and verdict added: the longest rule's, else block where ``model`` is ``least`` sure.

    A null URL, and one without ``://``, has an empty host and path, which no
    rule with either fits, and the model's verdict on nothing; very long URLs
    count whole; repeated rows are each judged; clashing columns of these names
    are replaced; an empty table stays empty. Rules are a parameter of a few
    dozen, in the order in which those of one length are tried.
    """
    host, path = split(F.col(url_col))
    made = ("host", "path", "rule", "probability", "verdict")
    found = pages.select(*[c for c in pages.columns if c not in made or c == url_col], host.alias("_host"), path.alias("_path"))
    text, verdict = rule(F.col("_host"), F.col("_path"), rules)
    likely = F.lit(0.0) if model is None else probability(model, F.col("_host"), F.col("_path"))
    found = found.withColumns({"_rule": text, "_probability": likely})
    out = {"host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_rule"), "probability": F.col("_probability"), "verdict": F.coalesce(verdict, F.when(F.col("_probability") >= least, "block").otherwise("allow"))}
    return found.select(*[c for c in pages.columns if c not in made], *(v.alias(k) for k, v in out.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, fit(labelled(spark))).select("page_id", "host", "path", "rule", "verdict", "probability")


def rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, paths and rules, which SQL can express: the learned verdict it cannot."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, None).select("page_id", "host", "path", "rule")


RULES_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r(domain, start) AS (VALUES ('com', '/'), ('example.com', '/en/'), ('www.example.com', '/en/'), ('net', '/es/'), ('net', '/fr/'))
SELECT page_id, host, path, (SELECT arg_max(domain || start, length(domain || start)) FROM r WHERE (host = domain OR suffix(host, '.' || domain)) AND starts_with(path, start)) AS rule FROM s
"""
