"""Operator 4, URL filter: rules, then logistic regression on hashed character n-grams of host and path.

The main path is DataFrame functions only. A rule fits its host and that host's subdomains where the
path starts with the rule's; the longest rule that fits decides. A page without a rule goes to the
model: the sum of the weights of its n-grams' buckets (host and path apart) plus a bias, in whole
millionths, so that sums are exact; above 0 blocks.

The model is trained on the driver from a small labelled table (`labelled_table`, made of general words by rule, or another
of at most MAX_LABELLED rows; more is an error).

Defined results: a null url and one without `://` have empty host and path and no rule; they are left
to the model, which lets what has no n-gram pass by its bias; repeated rows are judged alike; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# (verdict, host, path): the rules of the contract
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
GRAMS = (3, 4, 5)
DIGITS = 4
BUCKETS = 16**DIGITS
MAX_LABELLED = 10_000
UNIT = 1_000_000
ROUNDS, STEP, MOMENTUM, PENALTY = 300, 2.0, 0.9, 1e-4

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"

# Words of unwanted and of harmless sites, and words that both have.
_BLOCKED = (
    "casino", "poker", "roulette", "jackpot", "slots", "betting", "bets", "bingo", "gambling", "lottery", "pills", "viagra", "cialis", "xanax", "steroids",
    "porn", "xxx", "sex", "adult", "nude", "escort", "camgirl", "hookup", "fetish", "spam", "warez", "keygen", "cracked", "torrent", "phishing", "malware", "spyware", "adware",
    "popup", "ads", "adserver", "clicktrack", "track", "backlinks", "payday", "replica", "counterfeit", "scam", "hoax", "botnet", "stresser",
)
_ALLOWED = (
    "news", "garden", "library", "university", "weather", "recipes", "museum", "books", "linux", "council", "school", "travel", "produce", "dairy", "window", "running",
    "science", "health", "music", "sports", "bank", "photos", "archive", "hiking", "hotel", "law", "kitchen", "chess", "weaving", "astronomy", "trains", "history",
    "physics", "poetry", "bakery", "bicycle", "theatre", "village", "harbour", "orchard", "painting", "pottery", "knitting", "sailing", "mountain", "river", "forest",
    "dictionary", "grammar", "maths", "chemistry", "biology", "geology", "hospital", "dentist", "nursery", "parish", "mosque", "temple", "cathedral", "embassy", "parliament",
    "tax", "pension", "insurance", "plumbing", "carpentry", "electric", "solar", "furniture", "clothing", "shoes", "jewellery", "flowers", "wedding", "cinema", "podcast", "radio",
    "roads", "threads", "uploads", "heads", "soundtrack", "racetrack", "alphabet", "essex", "caterpillar", "crackers", "lotus", "adulthood", "betony", "slotted", "sexton", "spammed",
)
_COMPANIONS = ("best", "my", "online", "free", "live", "club", "shop", "the", "top", "zone", "cheap", "world", "win", "hub", "daily", "farm", "city", "x", "blog", "site")
_HOSTS = ("{w}.com", "www.{w}.org", "{c}-{w}.net", "{w}-{c}.com", "{c}{w}.example.org", "m.{w}{c}.com", "{w}.{c}.net", "blog.{c}-{w}.example.com", "{w}-{c}.example.net")
_WORD_PATHS = ("/{w}/{i}", "/en/{i}-{w}.html", "/{w}", "/shop/{w}/", "/a-{w}-b", "/{w}.html")
_PATHS = ("/", "/en/{i}", "/index.html", "/de/{i}.html", "/2024/{i}", "", "/fr/{i}/", "/es/{i}", "/about")


# What pronounceable names begin and end with, and their vowels.
_ONSETS = ("b", "br", "c", "ch", "cl", "d", "dr", "f", "fl", "g", "gr", "h", "j", "k", "l", "m", "n", "p", "pl", "pr", "qu", "r", "s", "sh", "st", "t", "th", "tr", "v", "w", "z")
_VOWELS = ("a", "e", "i", "o", "u", "ea", "ou", "y")
_CODAS = ("", "", "n", "r", "l", "s", "t", "m", "ck", "nd", "ng", "st")
#: Rows of the labelled table for each word, and invented names in it.
HOST_ROWS, PATH_ROWS, NAMES = 18, 6, 1500


def invented(k: int) -> str:
    """A pronounceable name of two or three syllables: names of which nothing is known are harmless."""
    out, x = "", int(hashlib.md5(b"name %d" % k).hexdigest(), 16)
    for _ in range(2 + k % 2):
        for parts in (_ONSETS, _VOWELS, _CODAS):
            x, i = divmod(x, len(parts))
            out += parts[i]
    return out


def labelled_table() -> tuple[tuple[str, int], ...]:
    """Urls by rule: each word in hosts, with companions and paths in turn, and in paths of hosts that have companions alone; harmless names."""
    out, many = [], len(_COMPANIONS)
    for words, label in ((_BLOCKED, 1), (_ALLOWED, 0)):
        for i, w in enumerate(words):
            for k in range(HOST_ROWS):
                host = _HOSTS[k % len(_HOSTS)].format(w=w, c=_COMPANIONS[(5 * i + 7 * k) % many])
                out.append((f"https://{host}{_PATHS[(i + 2 * k + k // 9) % len(_PATHS)].format(i=(37 * i + 101 * k) % 1000)}", label))
            for k in range(PATH_ROWS):
                host = _HOSTS[(i + k) % len(_HOSTS)].format(w=_COMPANIONS[(i + 3 * k) % many], c=_COMPANIONS[(3 * i + 5 * k + 1) % many])
                out.append((f"https://{host}{_WORD_PATHS[k % len(_WORD_PATHS)].format(w=w, i=i)}", label))
    for k in range(NAMES):
        host = _HOSTS[k % len(_HOSTS)].format(w=invented(k), c=_COMPANIONS[k * 7 % many])
        path = _WORD_PATHS[k % len(_WORD_PATHS)].format(w=invented(NAMES + k), i=k) if k % 2 else _PATHS[k % len(_PATHS)].format(i=k % 1000)
        out.append((f"https://{host}{path}", 0))
    return tuple(out)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path, as the DataFrame functions give them; for the labelled table."""
    m = re.match(_SPLIT, url or "")
    return (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")


def buckets_of(url: str | None) -> list[int]:
    host, path = split_url(url)
    whole = [f"h^{host}$", f"p{path}$"] if host or path else []
    return [int(hashlib.md5((w[0] + w[i : i + n]).encode()).hexdigest()[:DIGITS], 16) for w in whole for n in GRAMS for i in range(1, len(w) - n + 1)]


def train(labelled) -> tuple[list[int], int]:
    """Weights of the buckets and the bias, in units of 1 / UNIT, by full gradient descent with momentum."""
    rows = list(labelled)
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"a labelled table has {MAX_LABELLED} rows at most")
    found = [buckets_of(url) for url, _ in rows]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in found])
    gram = np.array([b for x in found for b in x], np.int64)
    label = np.array([y for _, y in rows], float)
    # both kinds weigh alike, whatever their number
    share = np.where(label == 1, 0.5 / max(1.0, label.sum()), 0.5 / max(1.0, (1 - label).sum())) if len(rows) else label
    weights, bias = np.zeros(BUCKETS), 0.0
    speed, lean = np.zeros(BUCKETS), 0.0
    for _ in range(ROUNDS):
        odds = bias + np.bincount(row, weights[gram], len(rows))
        off = share * (1 / (1 + np.exp(-np.clip(odds, -50, 50))) - label)
        speed = MOMENTUM * speed - STEP * (np.bincount(gram, off[row], BUCKETS) + PENALTY * weights)
        lean = MOMENTUM * lean - STEP * float(off.sum())
        weights, bias = weights + speed, bias + lean
    return [round(w * UNIT) for w in weights.tolist()], round(bias * UNIT)


@lru_cache(1)
def default_model() -> tuple[tuple[int, ...], int]:
    weights, bias = train(labelled_table())
    return tuple(weights), bias


def host_of(url: str = "url") -> Column:
    found = F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def _fits(host: str, path: str) -> Column:
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def _longest_first(rules):
    return sorted(rules, key=lambda r: -len(r[1] + r[2]))


def by_rule(rules, value) -> Column:
    """`value` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(_longest_first(rules)):
        out = F.when(_fits(rule[1], rule[2]), F.lit(value(rule))).otherwise(out)
    return out


def model_sum(weights, bias: int) -> Column:
    """The model's log odds in units of 1 / UNIT: above 0 blocks. Exact, in whole numbers."""
    table_of = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")

    def grams(whole: Column, kind: str, size: int) -> Column:
        n = F.length(whole) - (size - 1)
        starts = F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.conv(F.substring(F.md5(F.concat(F.lit(kind), F.substring(whole, i, F.lit(size)))), 1, DIGITS), 16, 10).cast("int"))

    some = (F.col("host") != "") | (F.col("path") != "")
    found = F.when(some, F.concat(*(g for n in GRAMS for g in (grams(F.concat(F.lit("^"), "host", F.lit("$")), "h", n), grams(F.concat("path", F.lit("$")), "p", n))))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(F.transform(found, lambda b: F.get(table_of, b)), F.lit(bias).cast("bigint"), lambda a, x: a + x)


def judge(pages: DataFrame, rules=RULES, model=None) -> DataFrame:
    """page_id, host, path, rule, verdict, model_sum of each row; model_sum is null where a rule decides."""
    weights, bias = model or default_model()
    split = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    ruled = split.withColumns({"rule": by_rule(rules, lambda r: r[1] + r[2]), "ruled": by_rule(rules, lambda r: r[0])})
    summed = ruled.withColumn("model_sum", F.when(F.col("rule").isNull(), model_sum(weights, bias)))
    verdict = F.coalesce("ruled", F.when(F.col("model_sum") > 0, "block").otherwise("allow"))
    return summed.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "model_sum")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def oracle() -> str:
    weights, bias = default_model()

    def cases(value) -> str:
        fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value((v, h, p))}'" for v, h, p in _longest_first(RULES))
        return f"CASE {fits} END"

    gram = "[('0x' || substr(md5('{k}' || substr({w}, i, {n})), 1, {d}))::INT FOR i IN range(1, length({w}) - {n} + 2)]"
    grams = " || ".join(gram.format(k=k, w=w, n=n, d=DIGITS) for n in GRAMS for k, w in (("h", "('^' || host || '$')"), ("p", "(path || '$')")))
    return f"""
WITH w AS (SELECT [{','.join(map(str, weights))}]::BIGINT[] AS weights),
split AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{_SPLIT}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '{_SPLIT}', 2), '') AS path FROM pages),
ruled AS (SELECT *, {cases(lambda r: r[1] + r[2])} AS rule, {cases(lambda r: r[0])} AS ruled, CASE WHEN host <> '' OR path <> '' THEN {grams} ELSE [] END AS grams FROM split),
summed AS (SELECT page_id, host, path, rule, ruled, CASE WHEN rule IS NULL THEN ({bias} + coalesce(list_sum([weights[g + 1] FOR g IN grams]), 0))::BIGINT END AS model_sum FROM ruled, w)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN model_sum > 0 THEN 'block' ELSE 'allow' END) AS verdict, model_sum FROM summed
"""
