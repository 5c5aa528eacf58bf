"""Fill-in-the-middle, URL rules and bit-plane clusters against plain versions, and their behaviour on odd rows."""

import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bitplanes, infill, queries, url_rules

from ..conftest import SF
from .test_text_operators import LONG, ODD, SCHEMA, key

# 11


def plain_fim(doc_id, text, unit="line", seed=7, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in marks):
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 50 else "psm"
    out = marks[0] + p + marks[1] + s + marks[2] + m if form == "psm" else marks[1] + s + marks[0] + p + marks[2] + m
    return len(units), form, len(p), len(m), out


LINES = [
    (10, "\n", "", "", 0, 0),
    (11, "\n\n\nä\n", "", "", 0, 0),
    (12, "one\r\ntwo\rthree\u2028four\n\nfive", "", "", 0, 0),
    (13, "has <M> in it\nand more", "", "", 0, 0),
    (14, "ends in <\n<S\n", "", "", 0, 0),
    (15, "😀é中\n" * 3000, "", "", 0, 0),
    (16, "x\x00y\n\x00", "", "", 0, 0),
]


@pytest.mark.parametrize("unit", infill.UNITS)
def test_op11_plain_version(spark, unit):
    rows = ODD + LINES
    got = infill.transform(spark.createDataFrame(rows, SCHEMA).repartition(2), unit=unit).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for doc_id, text, *_ in rows:
        n, form, p, m, out = plain_fim(doc_id, text, unit)
        want.append((doc_id, n, form, p, m, sha(out), sha(text or ""), out))
    assert key(map(tuple, got)) == key(want)


def test_op11_random_texts_fill_words():
    rng = random.Random(5)
    texts = ["".join(rng.choice("\n\nab é中😀\r") for _ in range(rng.randrange(40))) for _ in range(400)]
    data = [x.encode() for x in texts]
    offsets = np.cumsum([0, *map(len, data)])
    one, two = np.array([rng.randrange(1 << 32) for _ in texts]), np.array([rng.randrange(1 << 32) for _ in texts])
    for unit in infill.UNITS:
        found = infill.cuts(np.frombuffer(b"".join(data), np.uint8), offsets, one, two, unit)
        for i, text in enumerate(texts):
            units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
            a, b = sorted((int(one[i]) % (len(units) + 1), int(two[i]) % (len(units) + 1)))
            p, m = "".join(units[:a]), "".join(units[a:b])
            assert found.units[i] == len(units)
            assert (found.first[i] - offsets[i], found.second[i] - offsets[i]) == (len(p.encode()), len((p + m).encode()))
            assert (found.prefix_chars[i], found.middle_chars[i]) == (len(p), len(m))


def test_op11_sql_and_odd_tables(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op11_fill_in_middle(spark, SF)
    want = con.sql(queries.OP11_SQL)
    assert key(map(tuple, got.select(sorted(got.columns)).collect())) == key(want.select(*sorted(want.columns)).fetchall())
    assert infill.transform(spark.createDataFrame([], SCHEMA)).collect() == []
    rates = infill.transform(spark.createDataFrame([(i, "a\nb\nc") for i in range(500)], "doc_id long, text string"), rate=40, spm=0)
    forms = {r.form: r["count"] for r in rates.groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 150 < forms["psm"] < 250
    with pytest.raises(ValueError):
        infill.transform(got, unit="word")
    with pytest.raises(ValueError):
        infill.transform(got, sentinels=("ab", "ba", "x"))


# 12


def plain_url(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    found = {"h:" + x for x in host.split(".") if x}
    for step in filter(None, path.split("/")):
        end = re.search(r"\.[^.]+\Z", step)
        bare = re.sub("[0-9]+", "#", step[: end.start()] if end else step)
        found |= ({"p:" + bare} if bare else set()) | ({"p:" + end[0]} if end else set())
    query = re.match(r"[^?#]*\?([^#]*)", url)
    for pair in query[1].split("&") if query else ():
        found |= {"q:" + x for x in [pair.split("=", 1)[0]] if x}
    return host, path, tuple(sorted(found))


def plain_fixed(host, path, rules=url_rules.FIXED):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


def plain_rules(told, support=0.002, least=3, confidence=0.8):
    told = [(t, v) for t, v in told if t]
    enough = max(least, math.ceil(support * len(told)))
    total, labelled = {}, {}
    for found, verdict in told:
        for n in range(1, len(found) + 1):
            for s in itertools.combinations(found, n):
                total[s] = total.get(s, 0) + 1
                labelled[s, verdict] = labelled.get((s, verdict), 0) + 1
    sure = {k: (n / total[k[0]], n) for k, n in labelled.items() if n >= enough}
    beaten = lambda s, v, c: any(sure.get((tuple(x for x in s if x != gone), v), (-1, 0))[0] >= c for gone in s)
    return {k: x for k, x in sure.items() if x[0] >= confidence and not beaten(*k, x[0])}


def plain_judged(rows, told=None):
    parsed = [(i, u, *plain_url(u)) for i, u in rows]
    if told is None:
        told = {(u or "", t, plain_fixed(h, p)[1]) for i, u, h, p, t in parsed if plain_fixed(h, p)[1]}
    rules = plain_rules([(t, v) for _, t, v in told])
    out = []
    for i, _, h, p, t in parsed:
        name, verdict = plain_fixed(h, p)
        fits = [(-c, -n, -len(s), v, s) for (s, v), (c, n) in rules.items() if set(s) <= set(t)]
        out.append((i, h, p, name, verdict or (min(fits)[3] if fits else "allow")))
    return out, rules


URLS = [
    (1, None, "c", 1),
    (2, "", "c", 1),
    (3, "no-scheme.example.com/en/", "c", 1),
    (4, "http://", "c", 1),
    (5, "HTTP://WWW.Example.COM/en/Ä?x=1&&=2&x", "c", 1),
    (6, "https://example.com/en/7", "c", 1),
    (6, "https://example.com/en/7", "c", 1),
    (None, "ftp://a.net/fr/1.html#q?z=1", "c", 1),
    (7, "https://net/es/", "c", 1),
    (8, "https://subnet/es/", "c", 1),
    (9, "https://x.com?a=b", "c", 1),
    (10, "https://x.org/" + "long/" * 5000, "c", 1),
    (11, "a://b.org/c://d.net/es/\n", "c", 1),
    *((100 + i, f"http://s{i % 7}.{'spam' if i % 3 else 'news'}.{'net' if i % 2 else 'org'}/{'es' if i % 3 else 'en'}/{i}?r={i}", "c", 1) for i in range(120)),
]
PAGES = "page_id long, url string, rule string, tokens int"


def test_op12_plain_version(spark):
    want, rules = plain_judged([r[:2] for r in URLS])
    got = url_rules.judge(spark.createDataFrame(URLS, PAGES).repartition(3))
    assert key(map(tuple, got.collect())) == key(want)
    assert any(v == "block" for _, v in rules) and any(r[3] is None and r[4] == "block" for r in want)


def test_op12_given_labels_and_rules(spark):
    pages = spark.createDataFrame(URLS, PAGES)
    given = [(u, "block" if "spam" in u else "allow") for _, u, *_ in URLS if u and "s" in u[:9]] + [("http://odd.org/", None), (None, "block")]
    told = {(u, plain_url(u)[2], v) for u, v in given if u and v}
    found = {(tuple(r.rule_tokens), r.verdict): (r.confidence, r.n) for r in url_rules.mine(spark.createDataFrame([(list(t), v) for _, t, v in told], "tokens array<string>, label string")).collect()}
    assert found == plain_rules([(t, v) for _, t, v in told])
    got = url_rules.judge(pages, spark.createDataFrame(given, "url string, label string"))
    assert key(map(tuple, got.collect())) == key(plain_judged([r[:2] for r in URLS], told)[0])


def test_op12_sql_empty_and_native(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    got = queries.op12_url_rules(spark, SF)
    want = con.sql(queries.OP12_SQL)
    assert key(map(tuple, got.select(sorted(got.columns)).collect())) == key(want.select(*sorted(want.columns)).fetchall())
    assert url_rules.judge(spark.createDataFrame([], PAGES)).collect() == []
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())


# 13


def plain_clusters(rows, k=16, rounds=3):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, [math.floor(64 * v) for v in x]))
    order = sorted(kept, key=lambda r: hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest())
    centroids = [x for _, x in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x: min((far(x, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        centroids = [[sum(v) // len(groups[j]) for v in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *reversed(nearest(x))) for i, x in kept]
    by = {}
    for _, j, d in found:
        by[j] = by.get(j, 0) + d
    return [(i, j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in found]


VECTORS = "vec_id long, embedding array<float>, cluster string, planes int"


def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(i % 5, 0.4, 64)], "c", 1) for i in range(150)]
    same = rows[7][1]
    rows += [(200 + i, same, "c", 1) for i in range(60)] + [(7, same, "c", 1)]
    rows += [(300, None, "c", 1), (301, [0.5] * 63, "c", 1), (302, [0.5] * 65, "c", 1), (303, [], "c", 1), (304, [None] + [0.5] * 63, "c", 1)]
    rows += [(305, [float("nan")] + [0.5] * 63, "c", 1), (306, [float("inf")] + [0.5] * 63, "c", 1), (307, [-1e6] * 32 + [1e6] * 32, "c", 1), (308, [0.0] * 64, "c", 1), (309, [-1.0] * 64, "c", 1)]
    return [*rows, (None, [0.25] * 64, "c", 1)]


def test_op13_plain_version(spark):
    rows = vectors()
    got = bitplanes.cluster(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert key(map(tuple, got.collect())) == key(plain_clusters([r[:2] for r in rows]))


def test_op13_few_vectors_sql_and_empty(spark):
    rows = vectors()[:5]
    assert key(map(tuple, bitplanes.cluster(spark.createDataFrame(rows, VECTORS)).collect())) == key(plain_clusters([r[:2] for r in rows]))
    assert bitplanes.cluster(spark.createDataFrame([], VECTORS)).collect() == []
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = queries.op13_bitplane_clusters(spark, SF)
    want = con.sql(queries.ORACLE_SQL["op13_bitplane_clusters"])
    assert key(map(tuple, got.select(sorted(got.columns)).collect())) == key(want.select(*sorted(want.columns)).fetchall())


def test_op13_planes():
    rng = np.random.default_rng(4)
    for low, high in ((0, 1), (-1, 1), (-64, 64), (-5, 200), (-(1 << 27), 1 << 27), (3, 4), (-1, 0)):
        x, y = rng.integers(low, high, (50, 64)), rng.integers(low, high, (3, 64))
        planes = bitplanes.planes_of(x, bitplanes.bits_for(int(x.min()), int(x.max())))
        assert (bitplanes.integers_of(planes) == x).all()
        assert (bitplanes.squares(planes) == (x * x).sum(axis=1)).all()
        others = bitplanes.planes_of(y, bitplanes.bits_for(int(y.min()), int(y.max())))
        for j in range(3):
            assert (bitplanes.dots(planes, others[:, j]) == (x * y[j]).sum(axis=1)).all()


def test_op11_long_text_alone(spark):
    text = LONG + "\n" + LONG
    row = infill.transform(spark.createDataFrame([(4, text)], "doc_id long, text string").withColumn("n", F.lit("clash"))).first()
    assert row.restored_sha256 == hashlib.sha256(text.encode()).hexdigest() and row.n == 2
