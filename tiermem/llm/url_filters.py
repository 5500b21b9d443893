"""URL filters: domain rules first, then logistic regression on hashed character n-grams.

All of it is DataFrame and SQL functions. The classifier is trained from a small table
of labelled URLs (``LABELLED``) in its dual form: a coefficient for every labelled URL,
updated by full gradient steps over the table of their common n-grams. The weights of
the hashed n-grams (``BUCKETS`` numbers) then follow from the coefficients and are put
into the plan as one constant array, so judging a URL needs no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 15
GRAMS = (3, 4)
STEPS = 150
RATE = 0.08
DECAY = 0.002

#: The training table: URLs (without scheme) that are to be blocked (1) or allowed (0).
BLOCKED = """
casino-win.example.com/en/12 casino-royal.test/play www.best-casino.test/win m.casino-win.example.com/de/7 online-casino.test/bonus
free-bets.example.com/en/9 freebets.test/sports bets-online.test/odds www.free-bets.example.com/fr/31 blog.sport-bets.test/4
cheap-pills.example.com/es/2 pills-shop.test/cheap buy-pills.test/now m.cheap-pills.example.com/en/55 cheap-meds.test/pills
adult-x.example.com/en/8 adult-cams.test/x xxx-adult.test/video www.adult-x.example.com/de/71 adult-dating.test/free
spam-farm.example.com/en/5 link-farm.test/spam spam-links.test/11 blog.spam-farm.example.com/fr/3 seo-spam.test/farm
ads-track.example.com/en/77 track-ads.test/pixel ads-server.test/banner m.ads-track.example.com/es/8 click-track.test/ads
poker-win.test/jackpot slots-casino.test/spin lottery-win.test/prize viagra-pills.test/order porn-x.test/adult malware-farm.test/spam
"""
ALLOWED = """
www.example.com/en/12 m.example.org/en/7 blog.example.net/de/81 news.example.com/fr/5 example.org/es/40 library.test/books
tionsh.example.com/en/9 ththth.example.net/en/4 thther.example.org/de/66 www.therin.example.com/fr/2 m.ththan.example.net/es/13
blog.theron.example.org/en/19 ththing.example.com/en/30 tionble.example.org/de/8 tiontion.example.net/en/3 m.ththou.example.com/fr/1
weather.test/today science.test/physics recipes.test/soup history.test/rome garden.test/roses museum.test/visit school.test/maths
university.test/courses journal.test/article music.test/piano travel.test/train cityhall.test/forms health.test/heart
www.thered.example.org/en/21.html blog.ththat.example.com/en/50/ m.therble.example.net/de/90 ththwh.example.org/es/17.html
windows.test/update winter.test/snow adds.test/numbers address.test/map farming.test/soil tracking.test/parcel better.test/life
alphabets.test/letters pillow.test/bed adulthood.test/growth spamalot.test/musical freedom.test/law cheaper.test/flights
"""

#: Fixed by contract: host, path, verdict. A rule fits its host and all subdomains where the path starts with its path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if the url is null or has none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _hashed(text: Column, field: str) -> Column:
    """Buckets of the character n-grams of one field, digits made alike; characters are split once, so long texts stay linear."""
    def grams(letters: Column, n: int) -> Column:
        return F.transform(
            F.when(F.size(letters) >= n, F.sequence(F.lit(0), F.size(letters) - n)).otherwise(F.array().cast("array<int>")),
            lambda i: F.pmod(F.xxhash64(F.lit(field), *(F.get(letters, i + j) for j in range(n))), F.lit(BUCKETS)).cast("int"),
        )
    letters = F.split(F.concat(F.lit("^"), F.translate(text, "123456789", "000000000"), F.lit("$")), "")
    return F.flatten(F.array(*(grams(letters, n) for n in GRAMS)))


def features(host: Column, path: Column) -> Column:
    return F.array_distinct(F.concat(_hashed(host, "h"), _hashed(path, "p")))


def labelled(spark: SparkSession) -> DataFrame:
    """The training table: url, label."""
    rows = [f"('http://{u}', {y})" for text, y in ((BLOCKED, 1), (ALLOWED, 0)) for u in text.split()]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(rows) + " AS t(url, label)")


def train(table: DataFrame) -> tuple[list[float], float]:
    """Weights of the buckets and the constant, by gradient steps on the logistic loss in dual form.

    The table is small by contract: it is gathered into one row of arrays. Only the
    weights (``BUCKETS`` doubles) come to the driver.
    """
    x = table.select("label", features(host_of(F.col("url")), path_of(F.col("url"))).alias("x"))
    one = x.agg(F.sort_array(F.collect_list(F.struct("label", "x"))).alias("rows"))
    kernel = F.transform("rows", lambda a: F.transform("rows", lambda b: F.size(F.array_intersect(a["x"], b["x"])) + F.lit(1.0)))
    one = one.select("rows", kernel.alias("kernel"), F.transform("rows", lambda r: r["label"].cast("double")).alias("y"))

    def step(a: Column, _: Column) -> Column:
        def update(k: Column, i: Column) -> Column:
            margin = F.aggregate(F.zip_with(k, a, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
            return F.get(a, i) * (1 - RATE * DECAY) + RATE * (F.get(F.col("y"), i) - 1 / (1 + F.exp(-margin))) / 4
        return F.transform("kernel", update)

    # each step is a column of its own batch of rows: the loop over steps runs inside one expression
    fitted = one.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.transform("y", lambda _: F.lit(0.0)), step).alias("a"))
    terms = fitted.select(F.explode(F.zip_with("rows", "a", lambda r, v: F.struct(r["x"].alias("x"), v.alias("a")))).alias("t"))
    sums = terms.select(F.col("t.a").alias("a"), F.explode(F.concat("t.x", F.array(F.lit(-1)))).alias("bucket")).groupBy("bucket").agg(F.sum("a").alias("w"))
    weights, bias = [0.0] * BUCKETS, 0.0
    for bucket, value in sums.collect():
        if bucket < 0:
            bias = value
        else:
            weights[bucket] = value
    return weights, bias


def judge(pages: DataFrame, model: tuple[list[float], float], rules=RULES, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """All columns of ``pages`` but those named as the results, and ``host``, ``path``, ``rule``, ``verdict``, ``blocked_p``.

    The longest rule that fits decides; without one the classifier does. A null or odd
    url has an empty host and path; repeated rows each give a row; no shuffle.
    """
    weights, bias = model
    constant = F.from_json(F.lit("[" + ",".join(f"{w:.6g}" for w in weights) + "]"), "array<double>")
    new = ("host", "path", "rule", "verdict", "blocked_p")
    out = pages.withColumns({"url_": F.col(url_col)}).drop(*new).withColumns({"host": host_of(F.col("url_")), "path": path_of(F.col("url_"))})
    rule = verdict = F.lit(None).cast("string")
    for host, path, kind in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    margin = F.aggregate(features(F.col("host"), F.col("path")), F.lit(bias), lambda s, b: s + F.get(constant, b))
    out = out.withColumns({"rule": rule, "ruled_": verdict, "blocked_p": 1 / (1 + F.exp(-margin))})
    by_method = F.when(F.col("blocked_p") >= threshold, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("ruled_", by_method)).drop("ruled_", "url_")
