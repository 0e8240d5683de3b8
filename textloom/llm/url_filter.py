"""URL filters: allow/block rules by host and path, and a logistic regression on hashed
character n-grams of host and path for the URLs that no rule decides.

The model is trained on the driver from a small labelled table (its size is checked; the built-in one
has made-up hosts of some topics, none of them from any table it is applied to) and becomes one integer per hash bucket. Scoring is one projection of built-in functions:
no shuffle, no Python on executors.

Defined results: a null URL, or one without ``://``, has an empty host and path and is
judged by the model alone; very long URLs are judged whole; repeated rows are judged alike; an empty table gives an empty
table; columns named like the results (``host``, ``path``, ``rule``, ``verdict``) are
replaced, all others pass through.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: n-gram lengths over ``.host.`` and over the path; hex digits of the MD5 that name a bucket.
HOST_N, PATH_N, HEX = (3, 4, 5), (4, 5), 4
#: Weights are rounded to 1/SCALE, so that sums are exact in any order.
SCALE = 1 << 20
MAX_TRAINING_ROWS = 20_000
AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Fixed values: (host and path prefix, verdict).
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)

#: A small labelled table: made-up hosts by topic. Unwanted ones have each of their topic's words with some of BAIT.
UNWANTED = {
    "gambling": "casino poker jackpot slots betting roulette lottery bingo blackjack wager",
    "pharmacy": "pharmacy viagra meds tablets drugstore steroids prescription dietpill",
    "explicit": "porn sexy nude erotic escort xxx webcam milf",
    "advertising": "popup banner adserver clicks pixel beacon affiliate sponsor",
    "link schemes": "seo backlinks linkwheel bulkmail spinner traffic rankbooster doorway",
    "money": "loans payday prizes getrich replica credit doubler forex",
}
BAIT = "online bonus royal vip hot best shop deals club now mega direct 24 instant top".split()
WANTED = {
    "news": "daily-news morning-herald weekly-letter evening-post city-tribune river-gazette news-desk radio-bulletin",
    "learning": "university library school-board maths-lecture science-journal open-textbooks astronomy chess-problems",
    "software": "open-source python-guide linux-users code-review compiler-notes database-docs kernel-mailing package-index",
    "leisure": "garden-notes travel-diary photo-album cycling-club music-review book-club small-kitchen recipes",
    "public": "city-council museum health-service train-times weather-report harbour fire-brigade local-history",
    "places": "north-lake old-maps river-walks mountain-huts theatre village-fair castle-tours island-ferries",
}
#: Ordinary names are far more common than unwanted ones: every first word with some of the second.
FIRST = (
    "north south east west old new little great green blue red white silver golden river hill lake stone forest meadow sunny quiet early late inner outer upper lower "
    "thomas henry anna martin helen other under with from that ration entire better anderson tension haus garten schule verein kirche strasse reise leben kinder "
    "maison jardin ecole ville histoire theatre fleur voyage casa ciudad camino escuela tierra mundo"
).split()
SECOND = "press garden market house road bridge works studio review journal notes archive museum society union group blog team letters studies station school village gallery kitchen workshop".split()
ZONES = "com net org info biz eu".split()
PATHS = ("/", "/about", "/2024/05/post", "/index.php", "/page/3", "/item-17")


def labelled_by_topic() -> list[tuple[str, str, int]]:
    """The built-in labelled table: (topic, url, 1 for unwanted); each host has seven URLs."""
    out = []
    ordinary = " ".join(f"{w}{'-' if k % 2 else ''}{SECOND[(5 * i + 7 * k) % len(SECOND)]}" for i, w in enumerate(FIRST) for k in range(2))
    unwanted = {t: " ".join(f"{w}-{BAIT[(3 * i + 4 * k) % len(BAIT)]}" if k % 2 else f"{BAIT[(3 * i + 4 * k) % len(BAIT)]}{w}" for i, w in enumerate(words.split()) for k in range(3)) for t, words in UNWANTED.items()}
    for label, topics in ((1, unwanted), (0, WANTED | {"ordinary": ordinary})):
        for topic, names in topics.items():
            for i, name in enumerate(names.split()):
                for k, prefix in enumerate(("", "www.", "blog.", "m.")):
                    out.append((topic, f"http://{prefix}{name}.{ZONES[(i + k) % 6]}{PATHS[(i + k) % 6]}", label))
                for k, parent in enumerate(("hosting-place.com", "mysite.net", "homepages.org")):
                    out.append((topic, f"https://{('', 'www.', 'blog.', 'm.')[(i + k) % 4]}{name}.{parent}{PATHS[(i + k + 3) % 6]}", label))
    return out


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 for unwanted) of :func:`labelled_by_topic`."""
    return [(url, label) for _, url, label in labelled_by_topic()]


@dataclass(frozen=True)
class UrlModel:
    """``weights`` by bucket and ``bias``, all multiples of 1/SCALE as integers."""

    weights: dict[int, int]
    bias: int

    def dense(self) -> list[int]:
        out = [0] * 16**HEX
        for k, v in self.weights.items():
            out[k] = v
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of one URL, as :func:`host_and_path` has them."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    tail = rest[cut:]
    stop = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return rest[:cut].translate(str.maketrans(*AZ)), tail[:stop]


def buckets(url: str | None) -> list[int]:
    """Hash buckets of the n-grams of one URL, with repeats (driver side, for training)."""
    host, path = split_url(url)
    out = []
    for tag, s, sizes in (("h", f".{host}.", HOST_N), ("p", path, PATH_N)):
        for n in sizes:
            for i in range(max(len(s) - n, 0) + 1):
                out.append(int(hashlib.md5((tag + s[i : i + n]).encode()).hexdigest()[:HEX], 16))
    return out


def train(rows: Iterable[tuple[str, int]], epochs: int = 25, rate: float = 120.0, l2: float = 1e-6) -> UrlModel:
    """Logistic regression by stochastic gradient steps in a fixed order; bucket shares are the features.

    There is no bias: n-grams that no row has say nothing, however long a URL, and a URL of only such ones is allowed.
    """
    data = [(Counter(buckets(url)), label) for url, label in rows]
    order = sorted(range(len(data)), key=lambda i: hashlib.md5(str(i).encode()).digest())
    weights: dict[int, float] = {}
    for epoch in range(epochs):
        step = rate / (1 + epoch * 0.1)
        for i in order:
            grams, label = data[i]
            total = sum(grams.values())
            z = sum(weights.get(b, 0.0) * c for b, c in grams.items()) / total
            err = label - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            for b, c in grams.items():
                w = weights.get(b, 0.0)
                weights[b] = w + step * (err * c / total - l2 * w)
    return UrlModel({b: round(w * SCALE) for b, w in weights.items()}, 0)


def train_from_table(labelled: DataFrame, url: str = "url", label: str = "label") -> UrlModel:
    """Train from a DataFrame, refusing one that is not small."""
    rows = labelled.select(url, label).where(F.col(label).isNotNull()).orderBy(url, label).limit(MAX_TRAINING_ROWS + 1).collect()
    if len(rows) > MAX_TRAINING_ROWS:
        raise ValueError(f"the labelled URL table has over {MAX_TRAINING_ROWS} rows")
    return train((r[0], int(r[1])) for r in rows)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(raw, *AZ), path


def _grams_sum(chars: str, tag: str, n: int) -> str:
    return (
        f"aggregate(sequence(0, greatest(size({chars}) - {n}, 0)), 0L, (a, i) -> a + "
        f"get(w, cast(conv(left(md5(concat('{tag}', array_join(slice({chars}, i + 1, {n}), ''))), {HEX}), 16, 10) as int)))"
    )


def model_margin(host: str, path: str, model: UrlModel) -> Column:
    """Sum of weights plus bias times the number of n-grams, in units of 1/SCALE: positive means block."""
    csv = ",".join(map(str, model.dense()))
    parts = [_grams_sum("h", "h", n) for n in HOST_N] + [_grams_sum("p", "p", n) for n in PATH_N]
    count = [f"greatest(size(h) - {n}, 0) + 1" for n in HOST_N] + [f"greatest(size(p) - {n}, 0) + 1" for n in PATH_N]
    body = f"{' + '.join(parts)} + cast({model.bias} as bigint) * ({' + '.join(count)})"
    chars = "filter(split({}, ''), c -> c <> '')"
    # transform over a one-element array binds a value once for the whole expression
    return F.expr(
        f"transform(array(cast(split('{csv}', ',') as array<bigint>)), w -> "
        f"transform(array({chars.format(f"concat('.', {host}, '.')")}), h -> "
        f"transform(array({chars.format(path)}), p -> {body})[0])[0])[0]"
    )


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits; a struct of rule and verdict, null if none fits."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def judge(pages: DataFrame, model: UrlModel, rules: Iterable[tuple[str, str]] = RULES, url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``."""
    host, path = host_and_path(F.col(url))
    clean = pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    ruled = clean.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_model = F.when(model_margin("host", "path", model) > 0, "block").otherwise("allow")
    return ruled.withColumn("verdict", F.coalesce(F.col("rule.verdict"), by_model)).withColumn("rule", F.col("rule.rule"))


def oracle(model: UrlModel, rules: Iterable[tuple[str, str]] = RULES) -> str:
    """DuckDB SQL with the same rules and the same integer weights."""

    def grams(tag: str, s: str, n: int) -> str:
        return (
            f"list_sum([w[('0x' || left(md5('{tag}' || substr({s}, i::BIGINT, {n})), {HEX}))::INTEGER + 1] "
            f"for i in range(1, greatest(length({s}) - {n}, 0) + 2)])"
        )

    parts = [grams("h", "hs", n) for n in HOST_N] + [grams("p", "path", n) for n in PATH_N]
    count = [f"greatest(length(hs) - {n}, 0) + 1" for n in HOST_N] + [f"greatest(length(path) - {n}, 0) + 1" for n in PATH_N]
    cases = {"rule": "", "verdict": ""}
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, slash, rest = rule.partition("/")
        fits = f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash + rest}')"
        cases["rule"] += f" {fits} THEN '{rule}'"
        cases["verdict"] += f" {fits} THEN '{verdict}'"
    return f"""
WITH m AS (SELECT string_split('{",".join(map(str, model.dense()))}', ',')::BIGINT[] AS w),
a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
b AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{AZ[0]}', '{AZ[1]}') AS host,
      regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, '.' || host || '.' AS hs FROM b),
d AS (SELECT page_id, host, path, CASE{cases["rule"]} END AS rule, CASE{cases["verdict"]} END AS ruled,
      {" + ".join(parts)} + ({model.bias}) * ({" + ".join(count)}) AS margin FROM c, m)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN margin > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM d"""
