"""Operators on small tables against brute force: nulls, empties, very long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textwarden.llm import op1_telephony as op1
from textwarden.llm import op2_lines as op2
from textwarden.llm import op3_bagminhash as op3
from textwarden.llm import op4_packing as op4
from textwarden.llm import op5_html as op5
from textwarden.llm import op6_substrings as op6
from textwarden.llm import op7_chat as op7
from textwarden.llm import op8_toxicity as op8
from textwarden.llm import op9_decontaminate as op9
from textwarden.llm import op10_licenses as op10

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, media string, found string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(n=60, seed=3):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "lo ka mi né tu ßa ri so".split() for b in "na be di ko ly".split()]
    passage = " ".join(r.choices(vocabulary, k=55))
    rows = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "one two"), (-5, "Répété " * 300)]
    for k in range(n):
        words = r.choices(vocabulary, k=r.choice([3, 25, 80, 200]))
        text = " ".join(words[:10]) + "\n" + " ".join(words[10:])
        if k % 5 == 1:
            text += "\n" + passage
        if k % 7 == 3:
            text = rows[-1][1] or "x"
        if k % 11 == 5:
            text = (rows[-1][1] or "x").replace(words[0], "changed", 1)
        if k % 6 == 2:
            text += "\nRead our cookie notice."
        rows.append((k, text))
    rows.append((n, "lang " * 30_000))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, None if i is None or i % 4 == 0 else "en", None if i is None or i % 9 == 0 else f"s{i % 3}", None, "x", "y") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from textwarden.llm import common

    none = lambda *_: None
    cluster = lambda found: SimpleNamespace(conf=SimpleNamespace(get=found), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=none))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(cluster(none))
    assert common.shared_dir(cluster(lambda *_: "store://jobs")) == "store://jobs"
    with common.Scratch(spark) as scratch:
        kept = common.staged(scratch.table(spark.range(5)).where("id > 2"))
        path = scratch.paths[0].removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.exists(path) and kept.count() == 2


# --- telephony


def test_tables_of_g711():
    u, a = op1.ulaw_table(), op1.alaw_table()
    assert (u[0xFF], u[0x7F], u[0x80], u[0x00]) == (0, 0, 32124, -32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)


def plain_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step, size = int(op1.STEPS[index]), nibble & 7
            delta = ((2 * size + 1) * step) >> 3
            value = max(-32768, min(32767, value - delta if nibble & 8 else value + delta))
            index = max(0, min(88, index + int(op1.INDEX_STEPS[size])))
            out.append(value)
    return out


def test_adpcm_across_blocks_is_adpcm_by_block():
    data = random.Random(1).randbytes(64 * 9)
    got = op1.decode_adpcm(data)
    assert [list(map(int, x)) for x in got] == [plain_adpcm(data[k : k + 64]) for k in range(0, len(data), 64)]


def test_adpcm_of_other_blocks_to_the_end(spark):
    data = bytes(random.Random(5).randrange(256) for _ in range(256 + 100))
    df = spark.createDataFrame([(bytearray(data), "adpcm")], "payload binary, codec string")
    pcm = op1.read_wav(bytes(op1.decode_media(df, source=8000, target=8000, block=256).first().media))[3]
    assert len(pcm) == 2 * (505 + 193)
    assert pcm == b"".join(op1.decode_adpcm(d, len(d)).astype("<i2").tobytes() for d in (data[:256], data[256:]))
    assert len(op1.expand(data[:67], "adpcm")) == 121 and len(op1.expand(b"", "adpcm")) == 0


def test_wav_round_trip_and_resampling():
    for codec in ("pcm", "ulaw", "alaw", "adpcm"):
        data = bytes(range(128))
        assert op1.read_wav(op1.wav(data, codec, 8000))[:2] == (codec, 8000)
        assert op1.read_wav(op1.wav(data, codec, 8000))[3] == data
    x = np.array([0, 10, 20, -30], dtype=np.int16)
    assert list(op1.resample(x, 8000, 16000)) == [0, 5, 10, 15, 20, -5, -30, -30]
    assert list(op1.resample(x, 8000, 12000)) == [0, 6, 13, 20, -14, -30]


def plain_g711(byte, law):
    """One sample by the definition of G.711."""
    if law == "ulaw":
        byte ^= 0xFF
        size = ((2 * (byte & 15) + 33) << (byte >> 4 & 7)) - 33
        return 4 * (-size if byte & 128 else size)
    byte ^= 0x55
    exponent, mantissa = byte >> 4 & 7, byte & 15
    size = 2 * mantissa + 1 if not exponent else (2 * mantissa + 33) << (exponent - 1)
    return 8 * (size if byte & 128 else -size)


def plain_pcm_wav(samples):
    import io
    import wave

    twice = [v for a, b in zip(samples, [*samples[1:], samples[-1]]) for v in (a, (a + b) >> 1)]
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(b"".join(v.to_bytes(2, "little", signed=True) for v in twice))
    return twice, out.getvalue()


def test_telephony_query_against_brute_force(spark, docs, rows, empty, tmp_path):
    docs.union(docs.where("doc_id IN (3, -2)")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = op1.op1_telephony(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) + 2
    got = {r.doc_id: r for r in out}
    files = {r.doc_id: r for r in op1.store_texts(docs).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        g, f = got[i], files[i]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        header = b"RIFF" + (len(payload) + 38).to_bytes(4, "little") + b"WAVEfmt " + bytes.fromhex("12000000 0700 0100 401f0000 401f0000 0100 0800 0000") + b"data" + len(payload).to_bytes(4, "little")
        assert (g.media_bytes, g.media_sha256) == (len(header) + len(payload), sha(header + payload)) and bytes(f.media) == header + payload
        if len(payload) > 20_000:
            continue
        told = []
        for codec, linear in (("ulaw", [plain_g711(b, "ulaw") for b in payload]), ("alaw", [plain_g711(b, "alaw") for b in payload]), ("adpcm", [v for k in range(0, len(payload), 64) for v in plain_adpcm(payload[k : k + 64])])):
            samples, file = plain_pcm_wav(linear)
            assert g[f"pcm_{codec}_sha256"] == sha(op1.wav(file[44:], "pcm", 16000)) and op1.read_wav(bytes(f[f"pcm_{codec}"]))[3] == file[44:]
            rms = int(np.sqrt(np.longdouble(sum(v * v for v in samples) // len(samples))))
            told.append(f"{codec}={zlib.crc32(file[44:]):08x}:{rms}:{max(abs(v) for v in samples)}:{sum((a < 0) != (b < 0) for a, b in zip(samples, samples[1:]))}")
        assert g.feature == ";".join(told)
    assert op1.store_texts(empty).count() == 0


def test_decode_media(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xff\x00"), "ulaw"), (2, None, "alaw"), (3, bytearray(64), "adpcm"), (4, bytearray(2), None)], "i int, payload binary, codec string")
    got = {r.i: r.media for r in op1.decode_media(df).collect()}
    assert got[2] is None and got[4] is None
    assert op1.read_wav(bytes(got[1]))[:2] == ("pcm", 16000) and len(op1.read_wav(bytes(got[3]))[3]) == 2 * 2 * 121


# --- line dedup


def test_line_dedup(docs, rows, spark, empty):
    src = {r.doc_id: r.source for r in docs.collect()}
    pages, count = defaultdict(set), defaultdict(set)
    for i, t in rows:
        if t is not None:
            pages[src[i]].add(t)
            for line in {x.strip(" \t\r\x0b\x0c") for x in t.split("\n")} - {""}:
                count[src[i], line].add(t)
    gone = {k for k, v in count.items() if len(v) >= 5 and len(v) > 0.1 * len(pages[k[0]])}
    assert gone
    done = op2.drop_boilerplate(docs, counts=True)
    assert set(docs.columns) < set(done.columns)
    for r in done.collect():
        t = dict(rows)[r.doc_id]
        want = None if t is None else [x for x in t.split("\n") if (src[r.doc_id], x.strip(" \t\r\x0b\x0c")) not in gone]
        assert r.text == (None if want is None else "\n".join(want))
        assert (r.n_lines, r.n_dropped) == ((0, 0) if t is None else (len(t.split("\n")), len(t.split("\n")) - len(want)))
    assert op2.drop_boilerplate(empty).count() == 0


@pytest.mark.parametrize("most", [100_000, -1])
def test_line_dedup_of_odd_tables(spark, monkeypatch, most):
    monkeypatch.setattr(op2, "BROADCAST_LINES", most)
    names = ["_host", "_often", "_kept", "_salt", "_own", "host", "k", "n_lines", "n_dropped"]
    rows = [(h, f"Menu\nOwn {i}" if h != "z" else None, *[f"{n}{i}" for n in names]) for h in ("a", None, "z") for i in range(12)]
    rows += [rows[0], rows[0], ("a", "", *names), (None, "Menu \n\n" + "long " * 50_000, *names)]
    df = spark.createDataFrame(rows, ["source", "text", *names])
    out = op2.drop_boilerplate(df)
    cut = lambda h, t: None if t is None else "\n".join(x for x in t.split("\n") if x.strip() != "Menu")
    assert out.columns == df.columns
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str((h, cut(h, t), *rest)) for h, t, *rest in rows)
    counted = op2.drop_boilerplate(df, counts=True)
    assert counted.columns == [*df.columns[:-2], "n_lines", "n_dropped"] and counted.agg({"n_dropped": "sum"}).first()[0] == 27


def test_line_dedup_joins_beyond_the_broadcast(docs, monkeypatch):
    near = sorted((r.doc_id, r.text) for r in op2.drop_boilerplate(docs).collect() if r.text is not None)
    monkeypatch.setattr(op2, "BROADCAST_LINES", -1)
    assert near == sorted((r.doc_id, r.text) for r in op2.drop_boilerplate(docs).collect() if r.text is not None)


# --- near-duplicates


def test_signatures_estimate_weighted_similarity():
    r = random.Random(5)
    errors = []
    for _ in range(40):
        base = [b"w%d" % r.randrange(40) for _ in range(r.choice([10, 80, 300]))]
        other = [b"z" if r.random() < 0.15 else w for w in base]
        doc, name = op3.shingles([base, other], 1)
        d, s, w = op3.bags(doc, name)
        sig = op3.signatures(d, s, w, 2, 384)
        true = op3.overlap((s[d == 0], w[d == 0]), (s[d == 1], w[d == 1]))
        a, b = Counter(base), Counter(other)
        assert true == pytest.approx(sum((a & b).values()) / sum((a | b).values()))
        errors.append(((sig[0] == sig[1]).mean() - true) / np.sqrt(true * (1 - true) / 384 + 1e-6))
    assert abs(np.mean(errors)) < 0.6 and np.std(errors) < 1.6


def brute_classes(rows):
    bag = {}
    for i, t in rows:
        w = WORD.findall(lower(t))
        bag[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    up = {i: i for i in bag}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in bag:
        for b in bag:
            if a < b and bag[a] and bag[b] and sum((bag[a] & bag[b]).values()) >= 0.8 * sum((bag[a] | bag[b]).values()):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in bag}


def test_common_weights():
    r = random.Random(4)
    docs = [op3.bags(*op3.shingles([[b"w%d" % r.randrange(n) for _ in range(size)]])) for n, size in ((9, 60), (9, 80), (900, 300), (3, 40), (900, 7), (9, 60))]
    store = [(name.tobytes(), weight.astype(np.uint32).tobytes()) for _, name, weight in docs]
    got = op3.common_weights(tuple(map(list, zip(*store))), tuple(map(list, zip(*store[:4]))))
    for i, a in enumerate(docs):
        for j, b in enumerate(docs[:4]):
            x, y = (Counter(dict(zip(d[1].tolist(), d[2].tolist()))) for d in (a, b))
            assert got[i, j] == sum((x & y).values())


@pytest.mark.parametrize("chunk", [3, 10**6])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(op3, "CHUNK", chunk)
    chain = [(k, k + 1) for k in range(100, 130)]  # in the order of ids
    star = [(5, k) for k in range(10, 40)]
    edges = spark.createDataFrame([*chain, *star, (5, 10), (2, 1), (1, 2), (-7, 9)], "a bigint, b bigint").repartition(8)
    with op3.Scratch(spark) as scratch:
        got = {r.d: r.c for r in op3.components(edges, scratch).collect()}
        assert got == {**{k: 100 for k in range(100, 131)}, **{k: 5 for k in [5, *range(10, 40)]}, 1: 1, 2: 1, -7: -7, 9: -7}
        assert op3.components(edges.limit(0), scratch).count() == 0
        paths = [p for p in scratch.paths]
    assert paths and not any(os.path.exists(p.removeprefix("file:")) for p in paths)


@pytest.mark.parametrize("small", [32, 2])
def test_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(op3, "SMALL_BUCKET", small)
    monkeypatch.setattr(op3, "BLOCK", 4)
    if small == 2:  # all joins as beyond the broadcasts, with hot keys
        monkeypatch.setattr(op3, "BROADCAST_IDS", 0)
        monkeypatch.setattr(op3, "HOT_ROWS", 3)
    r = random.Random(9)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = [(-1, None), (-2, ""), (-3, "..."), (100, "one two"), (101, "One, two!"), (102, "one three")]
    for k in range(24):  # copies of a base that aren't all near each other
        w = list(base)
        for _ in range(k % 6):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, " ".join(f"u{r.randrange(10**6)}" for _ in range(60))) for k in range(5)]
    rows.append((5, rows[11][1]))  # a repeated row
    got = op3.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute_classes(list(dict(rows).items()))
    assert {g.doc_id: g.class_id for g in got} == want
    nulls = op3.near_duplicates(table(spark, [(None, "a b c d e f"), (7, "a b c d e f")])).collect()
    assert sorted((str(g.doc_id), str(g.class_id)) for g in nulls) == [("7", "7"), ("None", "None")]


def test_first_of_class(spark, empty):
    clash = spark.createDataFrame([(1, "a b c d e f g", 5, 6, 7), (2, "A b c d e f g.", 5, 6, 7), (3, None, 1, 1, 1), (3, None, 1, 1, 1)], "doc_id bigint, text string, _gone int, d int, class int")
    assert sorted(tuple(r) for r in op3.first_of_class(clash).collect()) == [(1, "a b c d e f g", 5, 6, 7), (3, None, 1, 1, 1), (3, None, 1, 1, 1)]
    assert sorted(tuple(r) for r in op3.near_duplicates(clash).collect()) == [(1, 1), (2, 1), (3, 3), (3, 3)]
    kept = op3.first_of_class(table(spark, [(1, "a b c d e f g"), (2, "A b c d e f g."), (3, "other words here"), (None, "a b c d e f g")]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    assert op3.first_of_class(empty).count() == 0


# --- packing


def test_best_fit_is_the_tightest_compatible_bin():
    r = random.Random(4)
    sizes = [r.randrange(1, 60) for _ in range(300)]
    sources = [r.choice([None, "a", "a", "b", "c"]) for _ in sizes]
    clusters = [r.choice([None, 1, 2, k + 10]) for k in range(len(sizes))]
    got = op4.best_fit(sizes, sources, clusters, 100, 2)
    bins = []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fit = [b for b in range(len(bins)) if 100 - sum(sizes[j] for j in bins[b]) >= sizes[k] and (sources[k] is None or sum(sources[j] == sources[k] for j in bins[b]) < 2) and (clusters[k] is None or all(clusters[j] != clusters[k] for j in bins[b]))]
        best = min(fit, key=lambda b: (100 - sum(sizes[j] for j in bins[b]), b), default=len(bins))
        start = sum(sizes[j] for j in bins[best]) if best < len(bins) else 0
        bins += [[]] * 0 if best < len(bins) else [[]]
        bins[best] = [*bins[best], k]
        assert got[k] == (best, start)


def test_pack_keeps_everything(docs, rows, empty):
    got = op4.pack(docs, capacity=64, per_source=2).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    tokens = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for i, t in rows}
    parts, bins = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r.doc_id].append((r.part, r.n_tokens))
        bins[r.shard, r.bin].append(r)
    for i, n in tokens.items():
        assert [p for p, _ in sorted(parts[i])] == list(range(-(-n // 64))) and sum(m for _, m in parts[i]) == n
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        assert at <= 64
        assert max(Counter(source[r.doc_id] for r in held if source[r.doc_id] is not None).values(), default=0) <= 2
        texts = [dict(rows)[r.doc_id] for r in held if dict(rows)[r.doc_id]]
        assert len(set(texts)) == len(texts)
    assert op4.pack(empty).count() == 0


def test_packing_query_against_brute_force(spark, tmp_path):
    """One shard, packed plainly: pieces largest first, ties by id, each into the tightest bin that may take it."""
    r = random.Random(8)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    rows = [(k, text(r.choice([3, 700, 1300, 2000, 4095, 9000])), r.choice([None, "hot", "hot", "b"])) for k in range(90)]
    rows += [(100 + k, rows[k][1], "hot") for k in range(10)] + [(200, None, "b"), (201, "", None), (202, " \n", "b"), (203, "x", "b"), (203, "x", "b"), (None, "y z", "hot")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS shard", "2 AS n", "3 AS c").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = []
    for i, t, s in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, len((x[1] or "").split()), x[2] is not None, x[2] or "")):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1
        pieces += [(i, p, min(4096, n - 4096 * p), s, t or None) for p in range(-(-n // 4096))]
    bins, want = [], {}
    for x in sorted((x for x in pieces if x[2] < 4096), key=lambda x: -x[2]):
        left = lambda b: 4096 - sum(y[2] for y in b)
        may = [k for k, b in enumerate(bins) if left(b) >= x[2] and (x[3] is None or sum(y[3] == x[3] for y in b) < 4) and (x[4] is None or all(y[4] != x[4] for y in b))]
        k = min(may, key=lambda k: (left(bins[k]), k), default=len(bins))
        if k == len(bins):
            bins.append([])
        want.setdefault((x[0], x[1], x[2]), []).append((k, sum(y[2] for y in bins[k])))
        bins[k].append(x)
    for x in (x for x in pieces if x[2] == 4096):
        want.setdefault((x[0], x[1], x[2]), []).append((len(bins), 0))
        bins.append([x])
    got = {}
    for g in op4.op4_packing(spark, str(tmp_path)).collect():
        got.setdefault((g.doc_id, g.part, g.n_tokens), []).append((g.bin, g.start))
    tied = lambda d: {k: len(v) for k, v in d.items()}
    assert tied(got) == tied(want)
    same = {k for k, v in want.items() if len(v) == 1 and k[0] is not None}
    assert {k: got[k] for k in same} == {k: want[k] for k in same}
    assert sorted(x for v in got.values() for x in v) == sorted(x for v in want.values() for x in v)


# --- HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="menu">
<nav><ul><li>Home</li></ul></nav><header>Site</header><div class="ad">Buy</div><aside>More</aside>
<article><header><h1>Big &amp; small</h1></header><p>First <b>bold<br>line.<p>Second&nbsp;line&#33;</p><div class="cookie-notice">We use cookies</div>
<form><label>Mail</label><input></form><section id="comments"><p>Nice!</p></section><p>Last</p></article><div id="disqus_thread">x</div><footer>&copy; me</footer></body></html>"""


def test_article_of_a_page():
    assert [t for t, z in op5.lines(PAGE) if z != op5.DROPPED] == ["Big & small", "First bold line.", "Second line!", "Last"]
    assert [t for t, z in op5.lines("<article><p>a &am") if z != op5.DROPPED] == ["a &am"]
    assert op5.lines("") == [] and op5.lines("<!-- open") == []
    assert [t for t, z in op5.lines("plain <div hidden>no</div> text <p style='display:none'>no</p>") if z != op5.DROPPED] == ["plain", "text"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>T</title><meta charset=u><body><article><p>Kept</article>", ["Kept"]),  # optional end tags left out
        ("<article><p>One<script>for(var i=0;i<n;i++)</script><p>Two</article><p>out", ["One", "Two"]),
        ("<article><p>One</p><SCRIPT>if(a<b)'</p>'</SCRIPT ><style>a<b</style>Two<textarea><p>no</textarea></article>", ["One", "Two"]),
        ("<main><article>a</article><p>main text</p></main><p>out</p>", ["a", "main text"]),
        ("<main><p>only main</p></main><p>out</p>", ["only main"]),
        ("<article><div class='search-and-rescue'>Found</div><div class='search-box'>Find</div><p id=sharing-economy>Shared</p><p class='share-buttons top'>Share</p></article>", ["Found", "Shared"]),
        ("<article><p>A <svg><text>no</text></svg>single <button>Push</button>line<p title=it's>that's</article>", ["A single line", "that's"]),
        ("<!-->a<!--->b<!-- c --!>d<!-- e", ["abd"]),
        ("<p title='a > b' alt=\"c>\">x</p><p =\"y\">z <", ["x", "z <"]),
        ("<article><noscript><p>no</p></noscript><template><article>no</article></template><p>yes", ["yes"]),
        ("<nav><article>no</article></nav><p>yes</p><script>open", ["yes"]),
        ("<article>" * 3000 + "deep" + "</article>" * 3000, ["deep"]),
    ],
)
def test_markup(page, want):
    assert [t for t, z in op5.lines(page) if z != op5.DROPPED] == want


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_is_a_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        a, b = r.sample(range(30), 12), r.sample(range(30), 15)
        for n in (30, 3):
            a, b = [x % n for x in a], [x % n for x in b]  # with repeated lines
            for i, j in (op5.common(a, b), tuple(zip(*op5._halved(a, b))) or ((), ())):
                assert [a[k] for k in i] == [b[k] for k in j] and len(i) == plain_lcs(a, b)
                assert all(x < y for s in (i, j) for x, y in zip(s, s[1:]))
    assert op5.common([1, 2, 1], [2, 1]) == ([1, 2], [0, 1])
    many = [k % 3 for k in range(5000)]
    assert len(op5.common(many, many[1:])[0]) == 4999


def test_html_query_against_brute_force(spark, tmp_path):
    r = random.Random(6)
    site = [f"Site line {k}" for k in range(6)]
    rows = []
    for k in range(60):
        own = [f"<p>Story {k % 50} line {j} {r.random()}</p>" for j in range(r.randrange(6, 12))]
        shared = [f"<div>{t}</div>" for t in r.sample(site, r.randrange(3))]
        body = "".join(own)
        body = f"<article>{body}<p>{r.choice(site)}</p></article>" if k % 3 == 0 else body
        rows.append((k, r.choice([f"http://h{k % 3}.example/{r.randrange(30):02d}", f"http://h{k % 3}.example/s/{k}"]), "".join(shared[:1]) + body + "".join(shared[1:]) + "<footer>Foot</footer>"))
    rows += [(100, None, None), (101, "http://h1.example/99", ""), (102, "http://h1.example/98", "<article><p>" + "long " * 50_000)]
    want = {}
    pages = {i: (op5.address(u), op5.lines(h or "")) for i, u, h in rows}
    gone, marked = defaultdict(set), 0
    order = sorted((i for i in pages if pages[i][1]), key=lambda i: (*pages[i][0], i))
    for x, y in zip(order, order[1:]):
        if pages[x][0][0] == pages[y][0][0]:
            a, b = pages[x][1], pages[y][1]
            for i, j in zip(*op5.common([t for t, _ in a], [t for t, _ in b])):
                gone[x] |= {i} if a[i][1] != op5.ARTICLE else set()
                gone[y] |= {j} if b[j][1] != op5.ARTICLE else set()
    for i, u, _ in rows:
        text = "\n".join(t for k, (t, z) in enumerate(pages[i][1]) if z != op5.DROPPED and k not in gone[i])
        want[i] = (u, text, len(text), len(gone[i]), sum(z == op5.DROPPED and k not in gone[i] for k, (_, z) in enumerate(pages[i][1])))
    spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS i", "2 AS gone", "3 AS text").repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: tuple(r)[1:] for r in op5.op5_html(spark, str(tmp_path)).collect()}
    assert got == want
    assert sum(v[3] for v in want.values()) > 60  # differencing decides
    twice = spark.createDataFrame([(1, "http://h.example/a", "<p>A</p><p>B</p>"), (1, "http://h.example/a", "<p>A</p><p>B</p>"), (None, None, "<p>C</p>")], "page_id bigint, url string, html string")
    assert sorted((r.page_id or 0, r.text) for r in op5.extract_main_text(twice).collect()) == [(0, "C"), (1, "A\nB"), (1, "A\nB")]


def test_neighbours_lose_what_they_share(spark):
    body = lambda k, more="": f"<div>Welcome to us</div><div><p>Story {k} begins.</p><p>Story {k} ends.</p></div><div>Terms apply</div>{more}"
    rows = [(k, f"http://h.example/a/{k}", body(k)) for k in range(6)]
    rows += [(10, "http://h.example/a/2x", body(2)), (11, None, "<p>alone</p>"), (12, "http://other.example/", body(9)), (13, "http://h.example/b", None), (14, "::bad::", ""), (15, "http://k.example/1", PAGE), (16, "http://k.example/2", PAGE)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumnRenamed("page_id", "page_id")
    got = {r.page_id: r.text for r in op5.extract_main_text(df).collect()}
    for k in (0, 1, 3, 4, 5):
        assert got[k] == f"Story {k} begins.\nStory {k} ends."
    assert got[12].startswith("Welcome") and got[11] == "alone" and got[13] == got[14] == ""
    assert got[15] == got[16] == "Big & small\nFirst bold line.\nSecond line!\nLast"
    shuffled = {r.page_id: r.text for r in op5.extract_main_text(df, broadcast_rows=-1).collect()}
    assert shuffled == got
    assert op5.extract_main_text(df.where("false")).count() == 0


def test_copies_and_thin_pages_lose_the_lines_of_the_site(spark):
    chrome = [f"Site line {k}" for k in range(10)]
    page = lambda own: "".join(f"<div>{t}</div>" for t in [*chrome[:5], *own, *chrome[5:]])
    own = lambda k, n: [f"Own {k} line {j}" for j in range(n)]
    rows = [(k, f"http://thin.example/{k}", own(k, 2)) for k in range(4)]
    rows += [(10, "http://two.example/a", own(10, 2)), (11, "http://two.example/b", own(11, 2)), (12, "http://two.example/c", None)]
    rows += [(20, "http://copies.example/a", own(20, 20)), *[(k, f"http://copies.example/b{k}", own(21, 20)) for k in range(21, 26)], (26, "http://copies.example/c", own(26, 20))]
    near = own(30, 60)
    rows += [*[(k, f"http://near.example/{k}", [*near, f"Seen {k} times"]) for k in range(30, 34)], (34, "http://near.example/z", own(34, 20))]
    rows += [(k, f"http://thrice.example/{k}", own(k // 3, 2)) for k in range(42, 51)]
    rows += [(k, f"http://same.example/{k}", own(60, 2)) for k in range(60, 63)]
    df = spark.createDataFrame([(k, u, None if o is None else page(o)) for k, u, o in rows], "page_id bigint, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in op5.extract_main_text(df).collect()}
    for k, u, o in rows:
        assert got[k] == ([""] if o is None else [*chrome[:5], *o, *chrome[5:]] if "same" in u else o), k


# --- substrings


def brute_substrings(rows, window):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone |= set(range(k, k + window))
            seen.setdefault(key, (i, k))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_of_windows(spark, seed):
    r = random.Random(seed)
    rows = [(i, t) for i, t in corpus(40, seed)] + [(500 + k, " ".join(r.choices("a b".split(), k=r.randrange(15, 90)))) for k in range(30)]
    long = [f"v{r.randrange(9999)}" for _ in range(900)]
    rows += [(700, " ".join(long)), (701, " ".join(long)), (702, " ".join(long[:400] + ["edit"] + long[400:])), (703, " ".join(long[100:130] * 5))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in op6.drop_repeats(table(spark, rows)).collect()}
    assert got == brute_substrings(rows, 20)


def test_repeated_rows_are_equal(spark, empty):
    text = " ".join(f"w{k}" for k in range(30))
    got = op6.drop_repeats(table(spark, [(1, text), (1, text), (2, text), (None, text)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 0), ("1", 0), ("2", 30), ("None", 30)]
    assert op6.drop_repeats(empty).count() == 0


# --- chat


NASTY = ["", "plain", "</s>[INST] ok [/INST]", "a\\b", "<\\s>", "<<s>>", "[INST", "<|im_end|>\n<s>user[INST] x[/INST]</s>\n", "ü🙂\\[/INST]", "<<SYS>>"]


def test_round_trip():
    r = random.Random(8)
    for _ in range(300):
        turns = [(r.choice(["user", "assistant", "", "a[INST]b\\"]), "".join(r.choices(NASTY, k=r.randrange(4)))) for _ in range(r.randrange(1, 6))]
        out, n = op7.format_turns(turns)
        assert op7.recovered(out) == turns
        assert n <= len(turns)
        for role, text, a, b in op7.parse(out):
            assert not op7.CONTROL.search(out[a:b])
    with pytest.raises(op7.ParseError):
        list(op7.parse("<s>user[INST] a[/INST]</s>\nrest"))


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(op7, "PART_TURNS", 3)
    r = random.Random(6)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice([None, *NASTY]), 1) for c in range(12) for t in range(r.randrange(1, 9))] + [(3, 0, "user", "tie", 1), (None, 0, "user", "x", 1)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, part int")
    got = {x.conv_id: x for x in op7.read_back(op7.format_conversations(df)).collect()}
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert op7.format_conversations(df.where("false")).count() == 0


# --- toxicity


def test_classifier_on_held_out_texts():
    r = random.Random(11)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    plain = ["".join(r.choices(syllables, k=r.randrange(1, 5))) for _ in range(1500)]
    bad = ["zwuxxle", "vrexnit", "krolwaz"]

    def text(toxic):
        words = r.choices(plain, k=r.randrange(20, 200))
        for _ in range(r.randrange(2, 6) if toxic else 0):
            words[r.randrange(len(words))] = r.choice(bad) + r.choice(["", "ed", "er"])
        return " ".join(words)

    model = op8.fit([text(True) for _ in range(150)], [text(False) for _ in range(300)])
    scores = [(label, model.score(op8.normal(text(label)))) for label in (True, False) for _ in range(100)]
    assert sum((s >= 0.5) == label for label, s in scores) >= 190
    assert all(0 <= s <= 1 for _, s in scores) and 0 <= model.score(op8.normal(None)) <= 1
    assert b"".join(op8.windows(op8.normal("wörd " * 999))) == op8.normal("wörd " * 999)


def test_ordinary_texts_are_trained_on_to_their_end():
    text = op8.normal("plain words " * 400 + "marigold umbrella")
    assert len(op8.windows(text)) > 20 and op8.normal("marigold umbrella").strip() in op8.dictionaries([], [text]).ordinary


def test_no_labels(spark, docs, rows):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = op8.scored(docs, op8.fit_tables(docs, labels)).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.0}
    assert op8.without_toxic(docs, op8.fit_tables(docs, labels)).count() == len(rows)


def test_toxicity_query_against_brute_force(spark, tmp_path):
    import zstandard

    r = random.Random(13)
    plain = ["".join(r.choices(["ba", "do", "li", "mu", "né", "ro", "ta"], k=r.randrange(1, 5))) for _ in range(400)]
    text = lambda bad: " ".join(r.choices(plain, k=r.randrange(10, 90)) + r.choices(["zwuxxle", "vrexnit", "krolwaz"], k=3 * bad))
    rows = [(k, text(k % 4 == 0), "en", f"s{k % 3}") for k in range(240)] + [(300, None, None, None), (301, "", "fr", "x"), (302, "long " * 30_000, "en", "x"), (303, text(1), "en", "x"), (303, text(0), "en", "x"), (None, text(1), "en", "x"), (None, text(1), "en", "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "0.5D AS score", "1 AS t").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, int(k % 4 == 0)) for k in range(0, 240, 1)] + [(None, 1), (5, None), (302, 0)]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = op8.fit_tables(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))

    def size(content, window):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=op8._PARAMETERS).compress(window))

    def score(t):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower().encode())
        flat = b" " + b"".join(w[:6].upper() + w[6:] + b" " for w in words)
        found = sorted(size(model.ordinary, w) - size(model.toxic + model.ordinary, w) for w in op8.windows(flat)) or [0]
        x = [found[-1], sum(found[-3:]), sum(found) / len(found), np.log(len(found)), sum(v >= 3 for v in found) / len(found), np.log1p(sum(v >= 5 for v in found))]
        return 1 / (1 + np.exp(-(model.weights[0] + sum(w * (v - c) / s for w, v, c, s in zip(model.weights[1:], x, model.center, model.scale)))))

    got = sorted((g.doc_id if g.doc_id is not None else -1, round(g.score, 6), g.predicted, g.held_out) for g in op8.op8_toxicity(spark, str(tmp_path)).collect())
    brute = [(i, score(t)) for i, t, *_ in rows if len(t or "") < 9999]
    brute += [(302, score("long " * 30_000))]
    want = sorted((-1 if i is None else i, round(v, 6), int(v >= 0.5), None if i is None else zlib.crc32(str(i).encode()) % 5 == 0) for i, v in brute)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert {g[0]: g[3] for g in got if g[0] >= 0} == {w[0]: w[3] for w in want if w[0] >= 0}
    held = [(k % 4 == 0, dict((g[0], g[2]) for g in got)[k]) for k in range(240) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)  # labels that it never saw


# --- decontamination


def brute_hits(text, items, window=10):
    words = WORD.findall(lower(text))
    mask, found = set(), set()
    for i, t in items:
        w = WORD.findall(lower(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            one = w[k : k + window]
            for p in range(len(words) - len(one) + 1):
                if words[p : p + len(one)] == one:
                    mask |= set(range(p, p + len(one)))
                    found.add(str(i))
    return len(words), len(mask), sorted(found)


def test_items_found(spark, docs, rows, empty):
    source = dict(rows)
    items = [(1, source[1]), (2, "lobe lona"), (3, None), (4, "..."), (5, source[6]), (10, "One TWO"), (11, " ".join(source[9].split()[5:30]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1 << 20, 10):
        for r in op9.find_items(docs, bench, block_bytes=block).collect():
            assert (r.n_words, r.n_hit, r["items"]) == brute_hits(source[r.doc_id], items)
            raw = (source[r.doc_id] or "").encode()
            covered = sum(len(WORD.findall(lower(raw[s.start : s.end].decode()))) for s in r.spans)
            assert covered == r.n_hit
        kept = op9.decontaminated(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, t in rows if not brute_hits(t, items)[1]}
        share = {i: (lambda x: x[1] / x[0] if x[0] else 0.0)(brute_hits(t, items)) for i, t in rows}
        assert {r.doc_id for r in op9.decontaminated(docs, bench, max_share=0.3, block_bytes=block).collect()} == {i for i, v in share.items() if v <= 0.3}
    odd = spark.createDataFrame([(None, "one two", 1), (None, "x", 2), (7, "one two", 3), (7, "one two", 3), (7, "y", 4), (8, None, 5)], "doc_id bigint, text string, _h int")
    for block in (1 << 20, 10):
        assert sorted(r._h for r in op9.decontaminated(odd, bench, block_bytes=block).collect()) == sorted(r._h for r in op9.decontaminated(odd, bench, max_share=0.5, block_bytes=block).collect()) == [2, 4, 5]
        assert sorted(((r.doc_id or 0), r.n_words, r.n_hit) for r in op9.find_items(odd, bench, block_bytes=block).collect()) == [(0, 1, 0), (0, 2, 2), (7, 1, 0), (7, 2, 2), (7, 2, 2), (8, 0, 0)]
    assert op9.decontaminated(docs, bench.where("false")).count() == docs.count()
    assert op9.find_items(docs, bench.where("false")).where("n_hit > 0").count() == 0 and op9.find_items(empty, bench).count() == 0


# --- licences


def brute_licenses(text, df, files):
    """Base places and template places: votes by double loops, the weight in order by a plain table."""
    index = op10.build_index(df=df, files=files)
    words = [w.encode() for w in WORD.findall(lower(text))]
    places = sorted((p, n) for phrase, n in op10.BASE.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.encode().split())
    found, total = [], sum(index.idf[w] for p, n in places for w in next(x for x, y in op10.BASE.items() if y == n).encode().split())
    for label, ws, weight, keys in zip(index.labels, index.words, index.weight, index.keys):
        starts = sorted({p - q for p, w in enumerate(words) for q, x in enumerate(ws) if w == x and any(index.labels[t] == label for t, _ in index.postings.get(w, ()))})
        for near in op10.runs(starts):
            cells = sorted((q, p) for q, x in enumerate(ws) for p in {s + q for s in near} if 0 <= p < len(words) and words[p] == x)
            best = {}
            for q, p in cells:
                best[q, p] = index.idf[ws[q]] + max((v for (a, b), v in best.items() if a < q and b < p), default=0.0)
            if best and max(best.values()) >= 0.5 * weight:
                top = max(best.values())
                low, high = near[0] - 8, near[-1] + len(ws) + 8
                whole = [words[max(0, low) : high]]
                if all(any(w[k : k + len(key)] == key for w in whole for k in range(len(w))) for key in keys):
                    found.append((label, round(min(1.0, top / weight), 9)))
                    total += top
    return places, sorted(found), total / (total + op10.HALF)


def test_licenses_query_against_brute_force(spark, tmp_path):
    r = random.Random(12)
    notices = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3", "mit  LICENSE mit license", "Licensed under CC BY-NC 4.0.", "mit", "license mit"]
    rows = [(k, " ".join(r.choices(["the", "under", "license", "mit", "words", "of", *notices], k=r.randrange(1, 30)))) for k in range(40)]
    for k, (label, (template, _)) in enumerate(op10.TEMPLATES.items()):
        words = template.split()
        rows.append((100 + k, f"before {template.upper()} behind {template}"))
        rows.append((200 + k, "x y " + " ".join(w for w in words if r.random() > 0.1)))
        rows.append((300 + k, " ".join(words[: len(words) * 2 // 3]) + " z"))
    rows += [(90, None), (91, ""), (92, "long " * 60_000 + " MIT license"), (None, "mit license"), (93, "mit license"), (93, "mit license")]
    table(spark, rows).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    df = Counter(w.encode() for _, t in rows for w in set(WORD.findall(lower(t))))
    got = sorted(map(tuple, op10.op10_licenses(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t in rows:
        places, found, score = brute_licenses(t, df, len(rows))
        names = sorted({n for _, n in places})
        want.append((i, len(WORD.findall(lower(t))), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(names), ",".join(sorted({*names, *(x for x, _ in found)})), score))
        mine = op10.scan((t or "").encode(), op10.build_index(df=df, files=len(rows)))
        assert sorted((x, round(s, 9)) for x, s, _ in mine[2]) == found, i
    for g, w in zip(got, sorted(want, key=str)):
        assert g[:-1] == w[:-1] and g[-1] == pytest.approx(w[-1])
    by_id = {g[0]: g for g in got}
    for k, label in enumerate(op10.TEMPLATES):  # a whole text is found in both of its places and ranks above a mention
        assert label in by_id[100 + k][6].split(",")
    assert by_id[100][-1] > 0.8 > by_id[93][-1] > 0 == by_id[91][-1]
    assert sum(x == "mit-text" for x, _, _ in op10.scan(dict(rows)[100].encode(), op10.build_index())[2]) == 2
    assert op10.find_licenses(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_licence_with_a_word_in_each_line():
    index = op10.build_index()
    for label in ("mit-text", "bsd-text", "gpl-text"):
        template, keys = op10.TEMPLATES[label]
        text = " ".join(WORD.findall(template.lower()))
        for key in keys:
            text = text.replace(key, key.replace(" ", "_"))
        lines = " ".join(w for k, x in enumerate(text.split()) for w in ([x, "dnl"] if k % 4 == 3 else [x])).replace("_", " ")
        found = {x: s for x, s, _ in op10.scan(f"some words before {lines} and behind".encode(), index)[2]}
        assert 0.5 < found[label] <= 1.0000001, label
        assert label not in {x for x, _, _ in op10.scan(" ".join(reversed(template.split())).encode(), index)[2]}
