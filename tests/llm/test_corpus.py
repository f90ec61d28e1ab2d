import gzip
import math
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from fixtures import documents, edge_rows, prose

import corpus_pipeline
from conftest import SF
from vecloom.llm import bpe, language_id, lm, mixing, toxicity, warc
from vecloom.llm.queries import ORACLES, QUERIES


def same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in d[columns].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["op3_lm", "op10_mixing", "warc_flat"])
def test_sql(spark, name):
    same(spark, name)


# Language model


def brute_lm(texts, cutoffs=lm.CUTOFFS):
    grams = [Counter() for _ in range(lm.ORDER + 1)]
    for t in texts:
        s = (None,) * (lm.ORDER - 1) + tuple((t or "").encode())
        for i in range(lm.ORDER - 1, len(s)):
            for k in range(1, lm.ORDER + 1):
                grams[k][s[i - k + 1 : i + 1]] += 1
    kept = [{g: n for g, n in c.items() if n >= cutoffs[k - 1]} for k, c in enumerate(grams) if k]
    contexts = [defaultdict(list) for _ in kept]
    for k, own in enumerate(kept):
        for g, n in own.items():
            contexts[k][g[:-1]].append(n)

    def p(g, k):
        if k == 0:
            return 1 / 256
        low = p(g, k - 1)
        at = contexts[k - 1].get(g[-k:-1])
        return low if at is None else (kept[k - 1].get(g[-k:], 0) + len(at) * low) / (sum(at) + len(at))

    def score(t):
        s = (None,) * (lm.ORDER - 1) + tuple(t.encode())
        return sum(math.log(p(s[i - lm.ORDER + 1 : i + 1], lm.ORDER)) for i in range(lm.ORDER - 1, len(s))) / len(t.encode())

    return score


def test_lm_is_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, prose(rng, rng.randint(1, 300))) for k in range(25)] + [(25, "日本語"), (26, ""), (27, None), (27, "again"), (None, "nobody")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    score = brute_lm([t for _, t in rows])
    want = [(str(i), None if t is None else len(t.encode()), round(score(t), 5) if t else None) for i, t in rows]
    for options in ({}, {"part_bytes": 3000}):  # one part, and many
        got = [(str(r.doc_id), r.n_bytes, None if r.avg_logprob is None else round(r.avg_logprob, 5)) for r in lm.score(docs, **options).collect()]
        key = lambda r: (r[0], -1 if r[1] is None else r[1])
        for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) < 2e-5)


def test_lm_edges(spark):
    rows = edge_rows()
    got = lm.score(documents(spark, rows)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.n_bytes for r in got}[6] == len(rows[8][1].encode())
    assert lm.score(documents(spark, [])).count() == 0
    assert [r[:] for r in lm.score(documents(spark, [(1, None, None, None, None), (2, "", None, None, None)])).orderBy("doc_id").collect()] == [(1, None, None), (2, 0, None)]


def test_lm_tells_copies(spark):
    """A text that occurs twice is more likely than one that occurs once."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz     "
    once = ["".join(rng.choice(letters) for _ in range(400)) for _ in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*once, *once[:10]])], "doc_id bigint, text string")
    got = {r.doc_id: r.avg_logprob for r in lm.score(docs).collect()}
    assert min(got[k] for k in range(10)) > max(got[k] for k in range(10, 60))


# WARC


def record(rid, kind, concurrent=(), uri="http://a/", block=b"b"):
    return (rid, kind, uri, "2024", list(concurrent) if concurrent is not None else None, bytearray(block), True, 5, 6)


def captures(spark, rows, **options):
    df = spark.createDataFrame(rows, warc.RECORD + ", capture int, part int")
    return {(r.capture_id, r.part) if options else r.capture_id: r for r in warc.assemble(df, **options).collect()}


def ids(records):
    return [r.record_id for r in records]


def test_warc_assembly(spark):
    got = captures(
        spark,
        [
            record("q1", "request", ["r1"]),
            record("r1", "response"),
            record("m1", "metadata", ["q1"]),  # by way of the request
            record("m2", "metadata", ["r1"]),
            record("m5", "metadata", ["m1"]),  # farther still
            record("m6", "metadata", ["m5"]),
            record("r2", "response", ["q2"]),  # from the other side
            record("q2", "request", block=b"\xff\xfe"),
            record("p2", "request", ["r2"]),  # two requests
            record("q3", "request", ["gone"]),
            record("m3", "metadata", ["q3"]),
            record("m4", "metadata", None, None),
            record("w", "warcinfo"),
            record(None, "response"),
            record("r1", "response"),
            record("v", "revisit", ["v"], block=b""),
        ],
    )
    assert set(got) == {"r1", "r2", "q3", "m4", "v"}
    assert (ids(got["r1"].requests), got["r1"].response.record_id, ids(got["r1"].metadata), got["r1"].n_records) == (["q1"], "r1", ["m1", "m2", "m5", "m6"], 6)
    assert ids(got["r2"].requests) == ["p2", "q2"] and got["r2"].metadata == [] and got["r2"].requests[1].block == b"\xff\xfe"
    assert got["q3"].response is None and ids(got["q3"].metadata) == ["m3"]
    assert got["m4"].requests == [] and got["m4"].target_uri is None and got["v"].response.block == b""
    assert captures(spark, []) == {}


def test_warc_large_captures_are_parted(spark):
    rows = [record("r", "response"), *(record(f"m{k}", "metadata", ["r"]) for k in range(100)), record("s", "response")]
    got = captures(spark, rows, most_records=20)
    assert len([k for k in got if k[0] == "r"]) > 3 and got["r", 0].response and ("s", 0) in got
    assert sorted(i for r in got.values() for i in ids(r.metadata)) == sorted(f"m{k}" for k in range(100))
    assert sum(r.n_records for r in got.values()) == 102


def raw(block, length=None, kind="response", rid="<x>"):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n"
    return head.encode() + (f"Content-Length: {len(block) if length is None else length}\r\n" if length != "" else "").encode() + b"\r\n" + block


END = b"\r\n\r\n"
#: raw record, block, intact
CASES = [
    (raw(b"HELLO") + END, b"HELLO", True),
    (raw(b"HELLO"), b"HELLO", True),
    (raw(b"HELLO") + END + b"TRAILING", b"HELLO", True),
    (raw(b"HELLO", 99) + END, b"HELLO" + END, False),
    (raw(b"HELLO", "five") + END, b"HELLO", False),
    (raw(b"HELLO", "") + END, b"HELLO", False),
    (raw(b"", 0) + END, b"", True),
    (raw("日本".encode()) + END, "日本".encode(), True),
    (raw(b"\xff\x00\xfe") + END, b"\xff\x00\xfe", True),
]


def test_warc_parse_by_length(spark):
    rows = [(k, bytearray(x)) for k, (x, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "k int, raw binary")
    for k, (_, block, intact) in enumerate(CASES):
        r = warc.parse(df.where(f"k = {k}")).first()
        assert (bytes(r.block), r.intact) == (block, intact), k
    assert warc.parse(spark.createDataFrame([("no record",), ("",), (None,)], "raw string")).count() == 0


def test_warc_malformed_files(spark, tmp_path):
    whole = b"".join(raw(b"ONE", rid=f"<{k}>") + END for k in range(3))
    files = {
        "number": raw(b"X", "five", rid="<a>") + END + whole,
        "short": whole + raw(b"HELLO", 99, rid="<z>"),
        "gz": gzip.compress(whole) + gzip.compress(raw(b"A" * 5000, rid="<z>"))[:-20],
        "empty": b"",
        "noise": b"noise\r\n" + whole,
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        rows = {r.record_id: (bytes(r.block), r.intact) for r in warc.read(spark, [str(tmp_path / name)]).collect()}
        assert {k: rows.get(f"<{k}>") for k in range(3)} == {k: (b"ONE", True) if data else None for k in range(3)}, name
        assert name != "number" or rows["<a>"] == (b"X", False)
        assert name != "short" or rows["<z>"] == (b"HELLO", False)
        assert name != "gz" or not rows["<z>"][1]


def test_warc_pages(spark):
    long = "<p>日本</p>" * 50_000
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>", 1), (2, None, None, 2), (3, "http://c/\r\n\r\n", long, 3), (None, "http://d/", "x", 4), (1, "http://a/", "<p>x</p>", 1)], "page_id bigint, url string, html string, raw int")
    records = warc.parse(warc.records_of_pages(pages))
    assert records.count() == records.where("intact").count() == 12
    got = warc.assemble(records).collect()
    assert len(got) == 3 and all(r.requests and r.response and len(r.metadata) == 1 and r.n_records == 3 for r in got)
    assert {bytes(r.response.block).decode().split("\r\n\r\n", 1)[1] for r in got} == {"<p>x</p>", "", long}
    assert warc.records_of_pages(pages.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    raws = [r.raw for r in warc.records_of_pages(spark.read.parquet(f"{SF}/pages.parquet")).collect()]
    pick = lambda rows: sorted((r.record_id, r.type, r.target_uri, bytes(r.block), r.intact) for r in rows)
    want = pick(warc.parse(spark.createDataFrame([(x,) for x in raws], "raw string")).collect())
    (tmp_path / "a.warc").write_bytes("".join(raws).encode())
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x.encode()) for x in raws))
    for name in ("a.warc", "b.warc.gz"):
        assert pick(warc.read(spark, [str(tmp_path / name)]).collect()) == want


# Mixing


def brute_mix(rows, weights=None, percent=60, block=8, shard=64, seed=17):
    import hashlib
    import re

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    own = Counter((i, s or "", len(re.findall(r"[^ \t\n\r]+", t or "")), md5(f"{seed}:{'' if i is None else i}:{md5(t or '')}")) for i, t, s in rows)
    totals = Counter()
    for (_, s, n, _), m in own.items():
        totals[s] += n * m
    w = {s: math.sqrt(t) for s, t in totals.items()} if weights is None else weights
    shards = max(1, -(-sum(totals.values()) // shard))
    by = defaultdict(list)
    for (i, s, n, h), m in own.items():
        by[int(h[16:24], 16) % shards, s].append((h, -1 if i is None else i, n, m))
    blocks = {c: max(1, -(-sum(x[2] * x[3] for x in own) // block)) for c, own in by.items()}
    total = Counter()
    for (_, s), b in blocks.items():
        total[s] += b
    given = Counter()
    for _ in range(sum(total.values()) * percent // 100):
        left = [s for s in total if given[s] < total[s] and w.get(s, 0) > 0]
        if left:
            given[min(left, key=lambda s: (-w[s] / (2 * given[s] + 1), s))] += 1
    out, upto = [], Counter()
    for k, s in sorted(by):
        quota = given[s] * (upto[s] + blocks[k, s]) // total[s] - given[s] * upto[s] // total[s]
        upto[s] += blocks[k, s]
        before = 0
        for _, i, n, m in sorted(by[k, s]):
            at = min(before // block, blocks[k, s] - 1)
            out += [(i, s, k, at, n, quota)] * m * (at < quota)
            before += n * m
    return sorted(out)


MIXED = "doc_id bigint, text string, source string"


@pytest.mark.parametrize("weights", [None, {"s0": 5.0, "s1": 1.0, "s9": 2.0, "s2": 0.0}])
def test_mixing_is_brute_force(spark, weights):
    rng = random.Random(6)
    rows = [(k, prose(rng, rng.randint(1, 30)), f"s{rng.choice([0, 0, 0, 1, 2])}") for k in range(120)] + [(500, None, "s1"), (501, "", None), (None, "a b c", "s0"), (None, "a b d", "s0"), (502, "a", ""), (502, "a", ""), (3, "again and again", "s0")]
    docs = spark.createDataFrame(rows, MIXED)
    options = {"weights": weights, "block_tokens": 8, "shard_tokens": 64}
    got = mixing.mix(docs, **options)
    want = brute_mix(rows, weights)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == want
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.source or "") for r in mixing.chosen(docs, **options).collect())
    assert kept == sorted(r[:2] for r in want)


def test_apportionment_narrows(spark, monkeypatch):
    """The search over a grid gives what one by one does, with many equal sources too."""
    monkeypatch.setattr(mixing, "_CLOSE", 3)
    monkeypatch.setattr(mixing, "_GRID", 8)
    rng = random.Random(1)
    sources = [(f"s{k}", float(rng.choice([1, 1, 2, 7.5, 1e-3])), rng.choice([1, 1, 3, 40, 900])) for k in range(120)]
    total = sum(n for *_, n in sources)
    for budget in (1, 60, total // 2, total - 1, total):
        order = sorted(((-w / (2 * j + 1), s, j) for s, w, n in sources for j in range(n)))[:budget]
        got = {r.source: r.quota for r in mixing.apportion(spark.createDataFrame(sources, "source string, w double, blocks bigint"), budget).collect()}
        assert got == Counter(s for _, s, _ in order)


def test_small_sources_stay(spark):
    """Beside one large source, each of many small ones gets about its target, though a shard has fewer blocks than sources."""
    rng = random.Random(3)
    rows = [(k, prose(rng, 6), f"small{k % 150}") for k in range(900)] + [(1000 + k, prose(rng, 6), "hot") for k in range(900)]
    got = Counter(r.source for r in mixing.mix(spark.createDataFrame(rows, MIXED), block_tokens=8, shard_tokens=256).collect())
    assert all(got[f"small{k}"] > 0 for k in range(150)) and got["hot"] > 0


def test_mixing_edges(spark):
    rows = edge_rows()
    docs = documents(spark, rows)
    assert len(mixing.mix(docs, budget_percent=100).collect()) == len(rows)
    kept = mixing.chosen(docs, budget_percent=100)
    assert kept.columns == docs.columns and kept.count() == len(rows) and kept.exceptAll(docs).count() == 0  # null ids too
    for f in (mixing.mix, mixing.chosen):
        assert f(documents(spark, [])).count() == 0 and f(docs, weights={}).count() == 0 and f(docs, budget_percent=0).count() == 0
    # One row of an id is chosen, the others of that id stay out.
    same = spark.createDataFrame([(1, " ".join(["w"] * 8) + f" {k}", "s") for k in range(40)], MIXED)
    kept = mixing.chosen(same, block_tokens=9, shard_tokens=1000, budget_percent=50)
    assert kept.count() == 20


# Pipeline


def test_pipeline_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    _, _, rejected = language_id.fit(docs).classify([t for _, t, _ in rows])
    rows = [r for r, bad in zip(rows, rejected) if not bad]
    left = docs.join(spark.createDataFrame([(r[0],) for r in rows], "doc_id bigint"), "doc_id")
    model = toxicity.fit(left, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in rows if not model.judge(r[1])[1]]
    from test_dedup import brute

    group = brute([r[:2] for r in rows])
    rows = [r for r in rows if group[r[0]] == r[0]]
    chosen = {x[0] for x in brute_mix(rows, block=mixing.BLOCK_TOKENS, shard=mixing.SHARD_TOKENS)}
    b = bpe.vocabulary(bpe.DEFAULT_VOCABULARY)
    want = {i: b.encoding.encode_ordinary(t) for i, t, _ in rows if i in chosen}
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len(want) < docs.count() and {r.doc_id: r.tokens for r in got} == want


def test_pipeline_edges(spark, tmp_path):
    rng = random.Random(8)
    rows = [*edge_rows(), *((100 + k, prose(rng, 40), "en", f"s{k % 3}", 200) for k in range(12))]
    labels = spark.createDataFrame([(100, 0), (101, 1)], "doc_id bigint, toxic int")
    for name, part in (("some", rows), ("none", [])):
        d = str(tmp_path / name)
        documents(spark, part).write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs
            docs = stage(spark, docs, d)
            docs.write.parquet(f"{d}/{k}")
            docs = spark.read.parquet(f"{d}/{k}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == before.columns
                assert docs.exceptAll(before).count() == 0
            if k == 2 and part:  # one of the two equal rows, and the null id
                assert docs.where("doc_id = 1").count() == 1 and docs.where("doc_id is null").count() == 1
        assert corpus_pipeline.run(spark, d).count() == docs.count() == (0 if not part else docs.count())
        assert not part or docs.count()
