"""URL filtering: a blocked Bloom filter of listed URLs, then an exact join of what passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import inline_table, lower_ascii, read

#: Bits of a filter block, bits set for a key, and bits of the filter for each listed key.
BLOCK_BITS, HASHES, BITS_PER_KEY = 512, 6, 16
#: A filter of up to this many blocks (64 bytes each) is broadcast.
BROADCAST_BLOCKS = 500_000

RULES = [
    {"host": "net", "path": "/", "verdict": "block"},
    {"host": "example.net", "path": "/en/", "verdict": "allow"},
    {"host": "example.com", "path": "/de/", "verdict": "block"},
    {"host": "org", "path": "/fr/", "verdict": "allow"},
]
#: The registered query's list of URLs: every pair of these words as a site, and its numbered
#: mirrors, under three endings; each is listed with all its pages and subdomains.
LISTED_FIRST = ("adult", "ads", "bonus", "casino", "cheap", "click", "fast", "free", "hot", "lucky", "quick", "spam")
LISTED_SECOND = ("bets", "cash", "deals", "farm", "games", "link", "loans", "pills", "poker", "track", "win", "x")
LISTED_ENDS, LISTED_MIRRORS = ("com", "net", "org"), 64


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host with A-Z in lower case; both empty without a ``://`` or for null."""
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, r"^(?s:.*?)://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """(host, segments) of a URL's host and path in a form that equal addresses share.

    The host in lower case loses a user, a port and final dots; of the path's segments, empty ones
    and ``.`` go, and ``..`` takes the one before it away. Query and fragment are no part of it.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^(?s:.*)@", ""), r":[0-9]*$", ""), r"\.+$", "")
    none = F.array().cast("array<string>")

    def step(done: Column, one: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when((one == "") | (one == "."), done).when(one == "..", up).otherwise(F.concat(done, F.array(one)))

    plain = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    # The fold copies the path at each step; few paths need it.
    return bare, F.when(F.exists(plain, lambda x: x == ".."), F.aggregate(plain, none, step)).otherwise(plain)


def listed_urls(spark: SparkSession) -> DataFrame:
    """(url, verdict) of the list described at LISTED_FIRST."""
    site = F.concat_ws("-", F.get(F.array(*map(F.lit, LISTED_FIRST)), F.col("a").cast("int")), F.get(F.array(*map(F.lit, LISTED_SECOND)), F.col("b").cast("int")))
    number = F.when(F.col("m") > 0, F.col("m").cast("string")).otherwise("")
    n, k = len(LISTED_SECOND), len(LISTED_ENDS)
    rows = spark.range(len(LISTED_FIRST) * n * k * LISTED_MIRRORS).select(
        (F.col("id") % k).alias("e"), (F.floor(F.col("id") / k) % n).alias("b"), (F.floor(F.col("id") / (k * n)) % len(LISTED_FIRST)).alias("a"), F.floor(F.col("id") / (k * n * len(LISTED_FIRST))).alias("m")
    )
    end = F.get(F.array(*map(F.lit, LISTED_ENDS)), F.col("e").cast("int"))
    return rows.select(F.concat(F.lit("http://"), site, number, F.lit(".example."), end, F.lit("/")).alias("url"), F.lit("block").alias("verdict"))


def _bits(key: Column) -> list[tuple[Column, Column]]:
    """(word, bit of the word) of each of a key's bits in its block."""
    h = F.xxhash64(key, F.lit(1))
    nine = [F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(HASHES)]
    return [(F.shiftright(b, 6).cast("int"), b.bitwiseAND(F.lit(63)).cast("int")) for b in nine]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7): the filter of the column ``key``, a row for each block with a bit set."""
    one = lambda bit: F.expr("1L") if bit is None else F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    set_ = F.explode(F.array(*[F.struct(w.alias("w"), one(b).alias("m")) for w, b in _bits(F.col("key"))]))
    bits = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), set_.alias("s"))
    return bits.groupBy("block").agg(*[F.bit_or(F.when(F.col("s.w") == k, F.col("s.m")).otherwise(F.lit(0).cast("bigint"))).alias(f"w{k}") for k in range(BLOCK_BITS // 64)])


def possible(candidates: DataFrame, listed: DataFrame, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """The candidates whose ``key`` the filter of the listed keys passes: all listed ones, few others."""
    blocks = max(1, -(-listed.count() * BITS_PER_KEY // BLOCK_BITS))
    table = bloom(listed, blocks)
    table = F.broadcast(table) if blocks <= broadcast_blocks else table
    words = F.array(*[F.col(f"w{k}") for k in range(BLOCK_BITS // 64)])
    passes = F.lit(True)
    for w, b in _bits(F.col("key")):
        passes &= F.call_function("shiftright", F.get(words, w), b).bitwiseAND(F.lit(1).cast("bigint")) == 1
    met = candidates.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).join(table, "block")
    return met.where(passes).drop("block", *[f"w{k}" for k in range(BLOCK_BITS // 64)])


def _suffixes(host: Column, most: int) -> Column:
    """The host's last 1 to ``most`` labels."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))


def candidates(urls: DataFrame, lengths: list[int], labels: int, segments: int) -> DataFrame:
    """(url, key): every form of a URL that a rule or a listed URL may have.

    For rules, each host suffix with each path prefix of a rule's length; for listed URLs, each
    suffix of the canonical host with each run of its path's first segments.
    """
    host, own = canonical(F.col("host"), F.col("path"))
    wide = urls.select("url", "path", F.explode(_suffixes(F.col("host"), labels)).alias("suffix"))
    cut = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    ruled = wide.select("url", F.explode(F.transform(cut, lambda n: F.concat(F.lit("rule "), "suffix", F.lit(" "), F.substr(F.col("path"), F.lit(1), n)))).alias("key"))
    plain = urls.select("url", host.alias("host"), F.slice(own, F.lit(1), F.lit(segments)).alias("own"))
    wide = plain.select("url", "own", F.explode(_suffixes(F.col("host"), labels)).alias("suffix"))
    first = F.transform(F.sequence(F.lit(0), F.size("own")), lambda n: F.concat(F.lit("list "), "suffix", F.lit("/"), F.array_join(F.slice("own", F.lit(1), n), "/")))
    return ruled.union(wide.select("url", F.explode(first).alias("key")))


def judged(pages: DataFrame, rules: DataFrame, listed: DataFrame, default: str = "allow", id_col: str = "page_id", url: str = "url", broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for every page.

    ``rules`` has rows (host, path, verdict); a rule fits its host and all subdomains where the
    page's path starts with the rule's, both as they stand. ``listed`` has rows (url, verdict); a
    listed URL fits its canonical host and all subdomains, on itself and all that lies below its
    path. The longest rule that fits decides (host and path together; ties by code point); without
    one the longest listed URL does, and without that ``default``. Every way to shorten a URL to
    a listed form is a candidate key; the Bloom filter of all entries drops most, and a hash join
    on the whole key drops the rest. Forms have no more labels or segments than some entry has, so
    a very long URL makes no more keys than a short one.

    Equal URLs are judged once, and every page row comes back. A null URL, or one without
    ``://``, has empty host and path and fits nothing. Null or empty lists fit nothing. Extra
    columns are ignored. The distinct lengths of the rules' paths come to the driver.
    """
    named = rules.where("host <> '' and path is not null").select("host", "path", "verdict")
    ruled = named.select(F.concat(F.lit("rule "), "host", F.lit(" "), "path").alias("key"), F.concat("host", "path").alias("entry"), "verdict", F.lit(1).alias("is_rule"), F.size(F.split("host", r"\.")).alias("labels"), F.lit(0).alias("segments"))
    host, own = canonical(*parts(F.col("url")))
    split = listed.select(host.alias("host"), own.alias("own"), "verdict").where("host <> ''")
    form = F.concat("host", F.lit("/"), F.array_join("own", "/"))
    entries = ruled.union(split.select(F.concat(F.lit("list "), form), form, "verdict", F.lit(0), F.size(F.split("host", r"\.")), F.size("own"))).distinct()
    lengths = sorted(r[0] for r in named.select(F.length("path")).distinct().collect())
    most = entries.agg(F.max("labels"), F.max("segments")).first()
    host, path = parts(F.col(url))
    mine = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    urls = mine.select("url", "host", "path").distinct().where("host <> ''")
    asked = candidates(urls, lengths or [0], most[0] or 1, most[1] or 0)
    met = possible(asked, entries.select("key").distinct(), broadcast_blocks).join(entries, "key")
    first = F.max_by(F.struct("entry", "verdict", "is_rule"), F.struct("is_rule", F.length("entry"), "entry", "verdict"))
    best = met.groupBy("url").agg(first.alias("best"))
    return mine.join(best, "url", "left").select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.is_rule") == 1, F.col("best.entry")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("best.is_rule") == 0, F.col("best.entry")).alias("listed"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by RULES and by the list of ``listed_urls``, through ``judged``."""
    return judged(read(spark, sf_dir, "pages"), inline_table(spark, RULES, "host string, path string, verdict string"), listed_urls(spark))
