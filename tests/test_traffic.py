import itertools
import random
import struct

import pytest
from pyspark.sql import functions as F

from trafficloom import cli
from trafficloom.functions import keys as K
from trafficloom.operators import browser, clusters, fingerprints, flows, graph, model
from trafficloom.plans import components
from trafficloom.plans.components import connected_components
from trafficloom.plans.ranking import global_rank
from trafficloom.plans.skew import skewed_lookup
from trafficloom.sources import captures

PACKETS = captures.SCHEMA


def packet(file, stream, no, ts, a, ap, b, bp, cert=None, size=100, proto="tcp"):
    return (file, proto, str(stream), no, float(ts), size, a, ap, b, bp, cert)


def test_flows_orient_and_drop_spoilt_files(spark):
    rows = [packet("f", 0, 0, 1, "c", 50000, "s", 443), packet("f", 0, 1, 2, "s", 443, "c", 50000, "7", 40), packet("f", 1, 2, 3, "a", 53, "b", 53),
            packet("g", 0, 0, 1, "a", 2, "b", 1, "1"), packet("g", 0, 1, 1, "a", 2, "b", 1, "2"), packet("h", 0, 0, 1, "a", 2, "b", 1), packet("h", 0, 1, 1, "x", 3, "y", 4)]
    df = spark.createDataFrame(rows, PACKETS)
    got = flows.assemble_flows(df).orderBy("flow_idx").collect()
    assert [(r.src, r.sport, r.dst, r.dport, r.cert, r.lengths) for r in got] == [("c", 50000, "s", 443, "7", [100, -40]), ("b", 53, "a", 53, None, [-100])]
    with pytest.raises(ValueError):
        flows.assemble_flows(df, on_error="fail")
    assert flows.assemble_flows(df.limit(0)).count() == 0


def test_batches_equal_histogram_edges(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for width, t in ((300.0, rng.random(300) * 5000 + 1.6e9), (0.1, np.round(rng.random(200), 1)), (10.0, np.arange(0, 101, 10.0)), (5.0, np.array([4.0, 4.0]))):
        n = max(1, int(np.ceil((t.max() - t.min()) / width)))
        want = np.digitize(t, np.histogram(t, bins=n)[1][:-1])
        df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(t)], "flow_idx long, time_start double")
        assert [r.batch for r in flows.time_batches(df, width).orderBy("flow_idx").collect()] == want.tolist()


@pytest.mark.parametrize("hub, small", [(1000, 100_000), (1000, 0), (30, 0), (30, 300)])
def test_components_and_rank_and_lookup(spark, monkeypatch, hub, small):
    monkeypatch.setattr(components, "HUB_EDGES", hub)
    monkeypatch.setattr(components, "SMALL", small)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 700)] + [(999, k) for k in range(800, 950)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in {v for e in edges if e[0] != e[1] for v in e}}
    named = spark.createDataFrame([(f"é{a}", f"é{b}") for a, b in edges], "src string, dst string")
    texts = {r.node: r.component for r in connected_components(named).collect()}
    members = {}
    for x, c in got.items():
        members.setdefault(c, []).append(f"é{x}")
    assert texts == {x: min(m) for m in members.values() for x in m}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    ranked = global_rank(spark.createDataFrame([(x,) for x in (5, 3, 9, 1, 7)], "x long"), "nth", [F.col("x")])
    assert {(r.x, r.nth) for r in ranked.collect()} == {(1, 0), (3, 1), (5, 2), (7, 3), (9, 4)}
    rows = spark.createDataFrame([(1, i) for i in range(90)] + [(i, i) for i in range(2, 12)], "k long, i long")
    joined = skewed_lookup(rows, rows.groupBy("k").agg(F.count("i").alias("n")), "k", "n")
    assert joined.count() == 100 and joined.filter("k = 1 AND n = 90").count() == 90


def test_cliques_are_the_maximal_ones():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(0, 9)
        near = {i: set() for i in range(n)}
        for a, b in itertools.combinations(range(n), 2):
            if rng.random() < 0.5:
                near[a].add(b), near[b].add(a)
        full = [set(c) for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if all(b in near[a] for a, b in itertools.combinations(c, 2))]
        want = sorted(sorted(c) for c in full if not any(c < d for d in full))
        assert sorted(graph.cliques_of(near)) == want


def fp_table(spark, sets):
    return spark.createDataFrame([(sorted(s), n + 1) for n, s in enumerate(sets)], "keys array<string>, n_flows long").withColumn("fp_id", K.fingerprint_id(F.col("keys"))).select("fp_id", "keys", "n_flows")


def test_similarity_operators(spark):
    rng = random.Random(4)
    names = [f"d|1.1.1.{k}|443" for k in range(14)] + ["n|"]
    sets = list({frozenset(rng.sample(names, rng.randint(1, 9))) for _ in range(40)} | {frozenset(["n|"]), frozenset(["n|", names[0]])})
    df = fp_table(spark, sets)
    ids = {r.fp_id: frozenset(r["keys"]) for r in df.collect()}

    def sim(a, b):
        return len(a & b) / max(len(a | b), 1)

    def allowed(a, b, t):
        return (max(len(a), len(b)) - min(len(a), len(b))) / max(len(a), len(b), 1) <= 1 - t

    for t in (0.2, 0.4, 0.75):
        want = {(x, y) for x in ids for y in ids if x < y and sim(ids[x], ids[y]) >= t and allowed(ids[x], ids[y], t)}
        assert {(r.l, r.r) for r in fingerprints.similar_pairs(df, t, []).collect()} == want
        now = {x: ids[x] for x in ids}
        for x, y in sorted(want):
            now[x] = now[y] = now[x] | now[y]
        got = fingerprints.merge_map(df, t, []).collect()
        assert {r.fp_id: frozenset(r["keys"]) for r in got} == now and len(got) == len(ids)
    trains = df.filter("n_flows % 2 = 0")
    known = {r.fp_id: frozenset(r["keys"]) for r in trains.collect()}
    want = {}
    for x in ids:
        best = min(((-sim(ids[x], known[y]), y) for y in known if ids[x] & known[y]), default=None)
        if best:
            want[x] = (best[1], -best[0])
    got = {r.fp_id: (r.match_id, r.score) for r in fingerprints.closest(df, trains).collect()}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-12 for x in want)
    found = {r.fp_id: r.found for r in fingerprints.is_in(df, trains, 0.5).collect()}
    assert found == {x: x in want and want[x][1] >= 0.5 for x in ids}


def test_similar_pairs_by_rare_keys(spark):
    rng = random.Random(9)
    names = [f"d|2.2.2.{k}|443" for k in range(30)] + ["n|"]
    sets = []
    for _ in range(25):
        base = rng.sample(names, rng.randint(4, 22))
        sets += [base, [*base, f"c|{rng.randrange(99)}"], base[1:], [k for k in base if k != "n|"]]
    sets = list({frozenset(s) for s in sets if s})
    df = fp_table(spark, sets)
    ids = {r.fp_id: frozenset(r["keys"]) for r in df.collect()}
    for t in (0.1, 0.5, 0.8, 0.9, 0.95):
        want = {}
        for x, y in itertools.combinations(sorted(ids), 2):
            a, b = len(ids[x]), len(ids[y])
            score = len(ids[x] & ids[y]) / len(ids[x] | ids[y])
            if score >= t and (max(a, b) - min(a, b)) / max(a, b) <= 1 - t:
                want[x, y] = score
        got = fingerprints.similar_pairs(df.union(df), t, []).collect()
        assert len(got) == len(want) and {(r.l, r.r): r.score for r in got} == want
        some, rest = df.filter("n_flows % 3 = 0"), df.filter("n_flows % 3 <> 0")
        known = [ids[r.fp_id] for r in rest.collect()]
        found = {r.fp_id: r.found for r in fingerprints.is_in(some, rest, t).collect()}
        assert found == {r.fp_id: any(len(ids[r.fp_id] & k) / len(ids[r.fp_id] | k) >= t for k in known) for r in some.collect()}
    assert fingerprints.similar_pairs(df.limit(0), 0.9, []).count() == 0


def test_merged_numbers_of_flows_stay_in_range(spark):
    shared = [f"d|1.1.1.{k}|443" for k in range(6)]
    df = fp_table(spark, [[*shared, f"c|{k}"] for k in range(60)])
    now = {r.fp_id: (set(r["keys"]), r.n_flows) for r in df.collect()}
    for x, y in itertools.combinations(sorted(now), 2):
        now[x] = now[y] = (now[x][0] | now[y][0], min(now[x][1] + now[y][1], 2**63 - 1))
    got = {r.fp_id: (set(r["keys"]), r.n_flows) for r in fingerprints.merge_map(df, 0.5, []).collect()}
    assert got == now and max(n for _, n in got.values()) == 2**63 - 1


def test_fill_over_batches(spark):
    rows = [(0, 1, 0.0, None), (1, 1, 1.0, "a"), (2, 1, 2.0, None), (3, 1, 3.0, "b"), (4, 2, 10.0, None), (5, 2, 11.0, None), (6, 3, 12.0, "c"), (7, 4, 13.0, None)]
    df = spark.createDataFrame(rows, "flow_idx long, batch int, time_start double, fp_id string")
    got = {r.flow_idx: r.fp_id for r in fingerprints.fill_nearest(df).collect()}
    assert got == {0: "a", 1: "a", 2: "b", 3: "b", 4: None, 5: None, 6: "c", 7: None}
    got = {r.flow_idx: r.fp_id for r in fingerprints.fill_nearest(df, over_all=True).collect()}
    assert got == {0: "a", 1: "a", 2: "b", 3: "b", 4: "c", 5: "c", 6: "c", 7: "c"}


def test_rolling_equals_pandas(spark):
    import pandas as pd

    rng = random.Random(5)
    t = sorted(rng.choice([0, 5, 0.5]) * rng.randint(0, 30) for _ in range(120))
    rows = [(i, float(x), rng.randrange(4), rng.randrange(100), rng.randrange(100)) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "flow_idx long, time_start double, dest_id long, bytes_in long, bytes_out long")
    frame = pd.DataFrame(rows, columns=["i", "t", "d", "a", "b"]).set_index(pd.to_datetime([r[1] for r in rows], unit="s"))
    roll = frame.rolling("5s")
    want = pd.DataFrame({"n": roll.d.apply(lambda x: x.nunique()), "a": roll.a.mean(), "b": roll.b.mean()})
    got = browser.rolling(df).orderBy("flow_idx").toPandas()
    assert got.n_clusters.tolist() == want.n.astype(int).tolist()
    assert ((got.incoming - want.a.to_numpy()).abs() < 1e-9).all() and ((got.outgoing - want.b.to_numpy()).abs() < 1e-9).all()
    diff = want.reset_index(drop=True).diff().fillna(0)
    feats = browser.features(df).orderBy("flow_idx").toPandas()
    assert ((feats.d_incoming - diff.a).abs() < 1e-9).all() and ((feats.d_cluster - diff.n).abs() < 1e-9).all()


def certificate(serial):
    n = serial.to_bytes(9, "big")
    tbs = b"\xa0\x03\x02\x01\x02\x02" + bytes([len(n)]) + n + b"\x05\x00"
    body = b"\x30" + bytes([len(tbs)]) + tbs
    return b"\x30" + bytes([len(body)]) + body


def frame(src, dst, sport, dport, payload=b"", proto=6):
    head = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, 24, 0, 0, 0) if proto == 6 else struct.pack(">HHHH", sport, dport, 8 + len(payload), 0)
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(head) + len(payload), 0, 0, 64, proto, 0) + bytes(map(int, src.split("."))) + bytes(map(int, dst.split(".")))
    return b"\0" * 12 + b"\x08\x00" + ip + head + payload


def write_pcap(path, frames):
    with open(path, "wb") as out:
        out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        for ts, f in frames:
            out.write(struct.pack("<IIII", int(ts), round(ts % 1 * 1e6), len(f), len(f)) + f)


def tls(serial):
    der = certificate(serial)
    certs = len(der).to_bytes(3, "big") + der
    msg = len(certs).to_bytes(3, "big") + certs
    hand = b"\x0b" + len(msg).to_bytes(3, "big") + msg
    return b"\x16\x03\x03" + struct.pack(">H", len(hand)) + hand


def test_captures(spark, tmp_path):
    serial = 0x0123456789ABCDEF01
    write_pcap(tmp_path / "a.pcap", [(10.5, frame("10.0.0.1", "1.1.1.1", 50000, 443)), (11, frame("1.1.1.1", "10.0.0.1", 443, 50000, tls(serial))), (12, frame("10.0.0.1", "8.8.8.8", 5353, 53, b"x", 17)), (13, b"\0" * 60)])
    (tmp_path / "b.pcap").write_bytes(b"no capture")
    section = struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28)
    link = struct.pack("<IIHHII", 1, 20, 1, 0, 0, 20)
    f = frame("10.0.0.9", "1.1.1.1", 40000, 443)
    pad = b"\0" * (-len(f) % 4)
    block = struct.pack("<IIIIIII", 6, 32 + len(f) + len(pad), 0, 0, 7_500_000, len(f), len(f)) + f + pad + struct.pack("<I", 32 + len(f) + len(pad))
    (tmp_path / "c.pcapng").write_bytes(section + link + block)
    got = captures.read_captures(spark, str(tmp_path)).orderBy("file", "pkt_no").collect()
    assert [(r.proto, r.stream, r.ts, r.ip_src, r.port_dst, r.cert) for r in got] == [("tcp", "0", 10.5, "10.0.0.1", 443, None), ("tcp", "0", 11.0, "1.1.1.1", 50000, str(serial)), ("udp", "0", 12.0, "10.0.0.1", 53, None), ("tcp", "0", 7.5, "10.0.0.9", 443, None)]
    with pytest.raises(Exception):
        captures.read_captures(spark, str(tmp_path), on_error="fail").collect()


def segment(src, dst, sport, dport, seq, payload=b""):
    f = frame(src, dst, sport, dport, payload)
    return f[:38] + struct.pack(">I", seq) + f[42:]


def test_certificates_over_segments(spark, tmp_path):
    """In order, out of order, sent twice with an overlap, over a wrap of sequence numbers, broken off, over splits, and none at all."""
    chain = tls(77 << 40)
    hello = b"\x16\x03\x03\x00\x08\x02\x00\x00\x04abcd"
    whole = hello + chain
    a, b, c = whole[:20], whole[20:41], whole[41:]
    server = ("1.1.1.1", "10.0.0.1", 443)
    out, t = [], 0.0

    def send(port, parts):
        nonlocal t
        for seq, payload in parts:
            t += 0.25
            out.append((t, segment(*server, port, seq, payload)))

    send(1000, [(500, a), (520, b), (541, c), (900, b"\x17\x03\x03\x00\x01x")])
    send(1001, [(500, a), (541, c), (520, b)])
    send(1002, [(500, a), (500, a), (510, whole[10:41]), (541, c)])
    send(1003, [(2**32 - 7, a), (13, b), (34, c)])
    send(1004, [(500, a), (541, c)])
    send(1005, [(500, a[:1]), (501, b"plain")])
    send(1008, [(500, whole + b"\x14\x03\x03\x00\x01\x01")])
    send(1006, [(500, hello + b"\x14\x03\x03\x00\x01\x01")])
    out += [(t + 200 + k, frame("10.0.0.5", "8.8.8.8", 4000 + k % 3, 53, b"x" * 90, 17)) for k in range(300)]
    t += 600
    send(1007, [(500, a), (520, b)])
    out += [(t + k / 10, frame("10.0.0.6", "8.8.4.4", 4000 + k % 5, 53, b"y" * 90, 17)) for k in range(100)]
    t += 11
    send(1007, [(541, c)])
    write_pcap(tmp_path / "x.pcap", out)
    every = {n: sorted(map(tuple, captures.read_captures(spark, str(tmp_path), split_bytes=n).collect())) for n in (1 << 30, 1000)}
    assert every[1 << 30] == every[1000] and len(every[1000]) == len(out)
    by_port = {}
    for r in captures.read_captures(spark, str(tmp_path), split_bytes=5000).collect():
        by_port.setdefault(r.port_dst, set()).add(r.cert)
    assert {p: {x for x in by_port[p] if x} for p in range(1000, 1009)} == {p: {str(77 << 40)} if p in (1000, 1001, 1002, 1003, 1007, 1008) else set() for p in range(1000, 1009)}
    got = captures.read_captures(spark, str(tmp_path), through_spark=True).collect()
    assert sorted(map(tuple, got)) == every[1000]


def test_capture_blocks_and_headers(spark, tmp_path):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))

    section = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    ethernet, raw = block(1, struct.pack("<HHI", 1, 0, 0)), block(1, struct.pack("<HHIHHB3x", 101, 0, 0, 9, 1, 9) + struct.pack("<HH", 0, 0))
    f = frame("10.0.0.9", "1.1.1.1", 40000, 443)
    six = struct.pack(">IHBB", 6 << 28, 16 + 8 + 8 + 8 + 5, 0, 64) + b"\xfe\x80" + b"\0" * 13 + b"\x01" + b"\xfe\x80" + b"\0" * 13 + b"\x02"
    six += bytes([43, 0]) + b"\0" * 6 + bytes([44, 0]) + b"\0" * 6 + bytes([60, 0]) + b"\0" * 6 + bytes([17, 0]) + b"\0" * 6 + struct.pack(">HHHH", 9, 10, 13, 0) + b"hello"
    later = six[:40] + six[40:48] + bytes([44, 0]) + b"\0" * 6 + bytes([17, 0, 0, 8]) + b"\0" * 4 + b"data"
    old = block(2, struct.pack("<HHIIII", 0, 0, 0, 3_000_000, len(f), len(f)) + f)
    simple = block(3, struct.pack("<I", len(f)) + f)
    new = block(6, struct.pack("<IIIII", 1, *divmod(5_000_000_001, 2**32), len(six), len(six)) + six)
    rest = block(6, struct.pack("<IIIII", 1, 0, 7, len(later), len(later)) + later)
    (tmp_path / "a.pcapng").write_bytes(section + ethernet + simple + old + simple + raw + new + block(99, b"unknown") + rest)
    cut = section + ethernet + old + old
    (tmp_path / "b.pcapng").write_bytes(cut[:-8])
    (tmp_path / "c.pcapng").write_bytes(section + new)
    for n in (1 << 30, 1):
        got = captures.read_captures(spark, str(tmp_path), split_bytes=n).orderBy("file", "pkt_no").collect()
        assert [(r.file[-8:], r.proto, r.pkt_no, r.ts, r.len, r.ip_src, r.port_dst) for r in got] == [
            ("a.pcapng", "tcp", 0, 0.0, 40, "10.0.0.9", 443), ("a.pcapng", "tcp", 1, 3.0, 40, "10.0.0.9", 443), ("a.pcapng", "tcp", 2, 3.0, 40, "10.0.0.9", 443), ("a.pcapng", "udp", 3, 5.000000001, 85, "fe80::1", 10), ("b.pcapng", "tcp", 0, 3.0, 40, "10.0.0.9", 443)]
    assert captures.transport(1, f[:30]) is None and captures.transport(101, six[:50]) is None


def test_either_kind_of_file(spark, tmp_path):
    write_pcap(tmp_path / "a.pcap", [(10.5, frame("10.0.0.1", "1.1.1.1", 50000, 443))])
    (tmp_path / "b.tsv").write_text("1.5\t0\t\t6\t1.1.1.1\t1000\t\t2.2.2.2\t443\t\t60\n\n2.5\t0\t\t6\t1.1.1.1\t1000\t\t2.2.2.2\t443\t\t61\n")
    got = captures.read_packets(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.ts, r.len, r.cert) for r in got] == [(1.5, 60, None), (2.5, 61, None), (10.5, 40, None)] and got[0].pkt_no < got[1].pkt_no
    assert captures.read_packets(spark, str(tmp_path / "b.tsv"), "rows").count() == 2 and captures.read_packets(spark, str(tmp_path / "a.pcap"), "captures").count() == 1
    with pytest.raises(ValueError):
        captures.read_packets(spark, str(tmp_path), "other")
    assert captures.export_fields("TShark (Wireshark) 2.6.10 (Git)")[-1] == "ssl.handshake.certificate" and captures.export_fields("TShark 4.0.1 (x)")[-1] == "tls.handshake.certificate"
    with pytest.raises(ValueError):
        captures.export_fields("something else")


def test_rows(spark):
    hexed = certificate(77 + (1 << 65)).hex(":")
    lines = ["1.5\t0\t\t6\t1.1.1.1,9.9.9.9\t1000\t\t2.2.2.2\t443\t\t60,40\t" + hexed + ",aa", "", "2.5\t\t3\t17\t1.1.1.1\t\t5\t2.2.2.2\t\t53\t9", "3.5\t1\t\t6\t\t1\t\t\t2\t\t"]
    df = spark.createDataFrame([("f", x, i) for i, x in enumerate(lines)], "file string, value string, pkt_no long")
    got = captures.read_rows(df).orderBy("pkt_no").collect()
    assert [(r.proto, r.ip_src, r.ip_dst, r.len, r.cert) for r in got] == [("tcp", "1.1.1.1", "2.2.2.2", 60, str(77 + (1 << 65))), ("udp", "1.1.1.1", "2.2.2.2", 9, None)]
    assert captures.read_rows(df, compat=True).orderBy("pkt_no").first().len == 6040


def test_command_line(spark, tmp_path, capsys):
    rng = random.Random(8)
    for name, hosts in (("a", "123"), ("b", "456")):
        rows = [(t + rng.random(), frame(f"10.0.0.{t % 9 + 1}", f"1.1.{h}.1", 40000 + t, 443, tls(1000 + int(h)) if h in "14" else b"")) for t in range(0, 600, 20) for h in hosts]
        write_pcap(tmp_path / f"{name}.pcap", rows)
        cli.main(["--pcaps", str(tmp_path / f"{name}.pcap"), "--fingerprint", str(tmp_path / f"{name}.json")], spark)
    cli.main(["--recognition", "--train", str(tmp_path / "a.json"), str(tmp_path / "b.json"), "--test", str(tmp_path / "b.json")], spark)
    out = [x for x in capsys.readouterr().out.splitlines() if "-->" in x]
    assert out and all(x.split(": ")[0] == x.split("--> ")[1] for x in out)
    cli.main(["--detection", "0.5", "--train", str(tmp_path / "a.json"), "--test", str(tmp_path / "b.json")], spark)
    out = [x for x in capsys.readouterr().out.splitlines() if "-->" in x]
    assert out and all(x.endswith("-1") for x in out)
    with pytest.raises(SystemExit):
        cli.main(["--recognition"], spark)
    with pytest.raises(SystemExit):
        cli.main([], spark)


def test_stream(spark, tmp_path):
    from trafficloom.streaming import live

    rows = [packet("f", s, 10 * s + j, 300 * b + 40 * s + j, f"c{s}", 50000, f"s{s % 4}", 443, proto="tcp") for b in range(3) for s in range(b * 8, b * 8 + 8) for j in range(3)]
    df = spark.createDataFrame(rows, PACKETS)
    df.write.parquet(f"{tmp_path}/p/1")
    known = fp_table(spark, [{"d|s0|443", "d|s1|443", "n|"}]).withColumn("label", F.lit("app")).withColumn("ord", F.lit(0).cast("long"))
    seen = []
    stream = spark.readStream.schema(PACKETS).parquet(f"{tmp_path}/p/*")
    q = live.label_stream(stream, known, lambda out, epoch: seen.extend(out.collect()), late="1 second").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert seen and all(r.label == "app" for r in seen)


def test_key_functions(spark):
    r = spark.sql("SELECT array('c|9','c|10','d|1.1.1.1|443','n|') AS k").select(K.certificates_of(F.col("k")).alias("c"), K.destinations_of(F.col("k")).alias("d"), K.jaccard(F.col("k"), F.array(F.lit("c|9"))).alias("j"), K.jaccard(F.expr("array()"), F.expr("array()")).alias("z")).first()
    assert r.c == ["9", "10"] and r.d[0].port == 443 and r.j == 0.25 and r.z == 0.0
    x = spark.sql("SELECT id * 0.1D AS x FROM range(100)").select("x", K.time_bin(F.col("x"), 0.1).alias("b")).collect()
    assert all(v.b == int(v.x // 0.1) for v in x)


def test_graph_files(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, '{"a":"<&"}'), (1, 2, "{}")], "batch int, node_id long, label string")
    edges = spark.createDataFrame([(1, 1, 2, 0.5)], "batch int, u long, v long, weight double")
    import xml.etree.ElementTree as ET

    graph.write_graph(labels, edges, f"{tmp_path}/g.gexf")
    assert len(list(ET.parse(f"{tmp_path}/g.gexf").iter())) == 7
    graph.write_graph(labels, edges, f"{tmp_path}/g.gml", "gml")
    assert "weight 0.5" in (tmp_path / "g.gml").read_text()
    with pytest.warns(UserWarning):
        graph.write_graph(labels, edges, f"{tmp_path}/h", "odd")


def test_destinations_join_late_links(spark):
    rows = [(i, 1, d, 443, c, "x") for i, (d, c) in enumerate([("a", "1"), ("b", "2"), ("c", None), ("a", "3"), ("b", "3"), ("d", None)])]
    df = spark.createDataFrame(rows, "flow_idx long, batch int, dst string, dport int, cert string, label string")
    known = clusters.key_destinations(df)
    assert {r.key: r.dest_id for r in known.collect()} == {"d|a|443": 0, "d|b|443": 0, "c|1": 0, "c|2": 0, "c|3": 0, "d|c|443": 2, "d|d|443": 5}
    asked = spark.createDataFrame([(9, 1, "z", 1, "3"), (10, 1, "z", 1, None), (11, 2, "a", 443, "1")], "flow_idx long, batch int, dst string, dport int, cert string")
    assert [r.dest_id for r in clusters.lookup_destinations(asked, known).orderBy("flow_idx").collect()] == [0, -1, -1]


def test_model_without_labels_and_empty(spark):
    with pytest.raises(ValueError):
        model.TrafficModel().model
    with pytest.raises(ValueError):
        model.default_match(fp_table(spark, []).withColumn("ord", F.lit(0)), "common")


def test_fingerprints_that_no_flow_has_are_not_merged(spark, monkeypatch):
    """Of two similar fingerprints only one is given to flows, so it stays as it is."""
    shared = [f"d|1.1.1.{k}|443" for k in range(8)]
    held, other = [*shared, "d|2.2.2.2|443"], [*shared, "d|3.3.3.3|443"]
    fps = fp_table(spark, [held, other]).withColumn("batch", F.lit(1))
    name = {tuple(sorted(r["keys"])): r.fp_id for r in fps.collect()}
    given = spark.createDataFrame([(0, 1, 0.0, name[tuple(sorted(held))]), (1, 1, 1.0, None)], "flow_idx long, batch int, time_start double, fp_id string")

    class Made:
        def __init__(self, *_):
            self.fps, self.assigned = fps, given

    monkeypatch.setattr(fingerprints, "Tables", Made)
    got = fingerprints.generate(given, similarity=0.5).collect()
    assert [sorted(r["keys"]) for r in got] == [sorted(held)] * 2


def test_smoothing(spark):
    rng = random.Random(6)
    rows = [(i, rng.random() * 400, 1 if rng.random() < 0.04 else -1) for i in range(300)] + [(900, 500.0, 1), (901, 500.0, -1), (902, 510.0, -1), (903, 490.0, -1), (904, 510.000002, -1)]
    got = {r.flow_idx: r.prediction for r in browser.smooth(spark.createDataFrame(rows, "flow_idx long, time_start double, prediction int"), 10, 10).collect()}
    us = [round(t * 1e6) for _, t, _ in rows]
    for (i, _, _), t in zip(rows, us):
        assert got[i] == (1 if any(p == 1 and -10_000_000 <= t - h <= 10_000_000 for (_, _, p), h in zip(rows, us)) else -1)


def test_text_and_saved_clusters(spark, tmp_path):
    rows = [(0, 1, "a", 50000, "1.1.1.1", 443, "7", "x", 0.5, 61.25, 3, 0), (1, 1, "b", 50001, "2.2.2.2", 53, None, "x", 1.0, 1.0, 1, 1)]
    df = spark.createDataFrame(rows, "flow_idx long, batch int, src string, sport int, dst string, dport int, cert string, label string, time_start double, time_end double, n_packets long, dest_id long")
    assert df.select(flows.flow_text()).first()[0] == "[Time 00:00:00.500000 to 00:01:01.250000]               a:50000 <->         1.1.1.1:443   [Length 3]"
    assert clusters.destination_state(df).orderBy("dest_id").select(clusters.destination_text()).first()[0] == "NetworkDestination [   0] [size=   1] [IPs=[('1.1.1.1', 443)]] [labels={'x': 1}]"
    assert fp_table(spark, [["d|1|1"]]).select(model.fingerprint_text()).first()[0].endswith(") [size=   1]")
    clusters.save(df, f"{tmp_path}/c")
    again, known = clusters.load(spark, f"{tmp_path}/c")
    assert again.count() == 2 and {r.key for r in known.collect()} == {"d|1.1.1.1|443", "c|7", "d|2.2.2.2|53"}
    state = clusters.destination_state(df)
    nodes = spark.createDataFrame([(1, 0, [0], [0, 1])], "batch int, node_id long, bins array<int>, dest_ids array<long>")
    edges = spark.createDataFrame([], "batch int, u long, v long, weight double")
    graph.export(nodes, edges, state, f"{tmp_path}/loose.gexf", dense=False)
    graph.export(nodes, edges, state, f"{tmp_path}/dense.gexf")
    assert (tmp_path / "loose.gexf").read_text().count("<node ") == 2 and (tmp_path / "loose.gexf").read_text().count("<edge ") == 1 and (tmp_path / "dense.gexf").read_text().count("<node ") == 1


def test_model_files(spark, tmp_path):
    known = fp_table(spark, [["d|1.1.1.1|443", "c|9"], ["d|2.2.2.2|53", "n|"]]).withColumn("label", F.lit("app"))
    made = model.TrafficModel(batch=20.0)
    made.counts = known.withColumn("flow_idx", F.monotonically_increasing_id())
    made.save(f"{tmp_path}/m.json")
    import json

    value = json.loads((tmp_path / "m.json").read_text())
    (tmp_path / "other.json").write_text(json.dumps(value, indent=1))
    assert value["batch"] == 20.0 and len(value["fingerprints"]) == 2
    for paths in (["m.json"], ["other.json"], ["m.json", "other.json"]):
        again = model.TrafficModel()
        out = again.load(spark, *(f"{tmp_path}/{x}" for x in paths), parameters=True).collect()
        assert sorted((r["keys"], r.labels) for r in out) == [(["c|9", "d|1.1.1.1|443"], ["app"]), (["d|2.2.2.2|53"], ["app"])] and again.batch == 20.0
    assert model.by_label(known).first().fp_ids == [r.fp_id for r in known.orderBy("n_flows").collect()]
