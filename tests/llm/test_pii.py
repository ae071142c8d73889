import hashlib
import random
import re

import pytest

from trafficloom.llm import pii


def luhn(d):
    s = [int(c) for c in d][::-1]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([ -]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_equals_the_patterns():
    rng = random.Random(1)
    pieces = ["a@b.co", "@", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 555-0199", "+", "12", " ", "-", "é", "x.y%z@", "b..c", "٣", "9" * 17, "\n", "a_b@c-d.e.f@g.h"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 9)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000 + "@", "a@" * 50_000, "1." * 50_000, "+1" + "(" * 100_000, "token = " * 20_000, "[at]" * 20_000, "AB12" * 20_000,
                                  "0" * 200_000 + "1.2.3.4", "a." * 100_000 + "[at]b[dot]c", "a[at]" * 50_000, "x [at] y" + " [dot] z" * 50_000, "password=" + "aB3" * 100_000, "token" + " " * 100_000])
def test_long_texts_take_linear_time(text):
    pii.candidates(text)


def test_long_parts_and_whole_spans():
    found = pii.candidates("0" * 5000 + "1.2.3.4")
    assert [f[:3] for f in found] == [("ip", 0, 5007)]
    key = "aB3_" * 225
    text = f"login with password = '{key}' now"
    assert [f[:3] for f in pii.candidates(text)] == [("secret", 23, 923)]
    weights = pii.train_classifier([("secret", pii.candidates(text)[0][3], 50)])
    assert pii.redact(text, weights) == "login with password = '<SECRET>' now"
    name = "n" * 300 + " [at] " + "d" * 200 + " [dot] com"
    assert [f[:3] for f in pii.candidates(name)] == [("spelt", 0, len(name))]
    assert pii.spelt_addresses("..a.b(at)c (dot) d, [at] x [dot] y") == [(2, 18)]


def test_looser_spans_against_plain_patterns():
    """Spelt-out addresses by one plain pattern (its leading punctuation cut), bank accounts by their check sum, numbers by their ranges."""
    rng = random.Random(11)
    pieces = ["jo", ".", "-", "_", " ", "[at]", "(AT)", " [at] ", "[dot]", " (dot) ", "com", "a-b", "é", "[", "x1", "@"]
    plain_spelt = re.compile(r"[A-Za-z0-9._%+-]+ ?[\[(](?i:at)[\])] ?[A-Za-z0-9-]+(?: ?[\[(](?i:dot)[\])] ?[A-Za-z0-9-]+)+")
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 10)))
        want = []
        for m in plain_spelt.finditer(text):
            start = m.start()
            while not text[start].isalnum() and text[start] not in "[( ":
                start += 1
            if text[start].isalnum():
                want.append((start, m.end()))
        assert pii.spelt_addresses(text) == want, text
    account = "DE89 3704 0044 0532 0130 00"
    assert [c[:3] for c in pii.candidates(f"iban {account} ok")] == [("iban", 5, 5 + len(account))]
    assert pii.candidates(f"iban {account} ok")[0][3][0] == "+" and pii.candidates(f"iban {account[:-1]}1 ok")[0][3][0] == "-"
    assert [pii.candidates(f"x {n} y")[0][3][0] for n in ("123-45-6789", "000-45-6789", "666-45-6789", "900-45-6789", "123-00-6789", "123-45-0000")] == ["+", "-", "-", "-", "-", "-"]


def test_labelers_see_evidence_of_their_own():
    def cast(text):
        return pii.candidates(text)[0][3][:3]

    assert cast("token = 9b0b3c6a43eb78aa99cbd") == "+00"
    assert cast("deploy token = ghp_9b0b3c6a43eb78aa99cbd") == "+++"
    assert cast("a sample token = changeme-now") == "---"
    assert cast("version 1.2.3.4 of it") == "++-" and cast("host 127.0.0.1") == "+-+"


def test_em_against_one_row_per_span():
    """The same model, fitted to spans one by one instead of to counts of patterns."""
    rng = random.Random(8)
    kinds = ("email", "secret")
    patterns = sorted({(rng.choice(kinds), "".join(rng.choice("+-0") for _ in range(3)) + "1") for _ in range(25)})
    counted = [(*p, rng.randint(1, 40)) for p in patterns]
    spans = [(k, v) for k, v, n in counted for _ in range(n)]
    start = {0: {"+": 0.3, "-": 0.7}, 1: {"+": 0.85, "-": 0.15}}
    weak = {0: {"+": 3, "-": 7}, 1: {"+": 8.5, "-": 1.5}}
    prior, trust = dict.fromkeys(kinds, 0.7), [{c: dict(start[c]) for c in (0, 1)} for _ in range(3)]
    for _ in range(60):
        post = []
        for k, v in spans:
            a, b = 1 - prior[k], prior[k]
            for j in range(3):
                a, b = a * trust[j][0].get(v[j], 1), b * trust[j][1].get(v[j], 1)
            post.append(b / (a + b))
        for k in kinds:
            own = [p for p, s in zip(post, spans) if s[0] == k]
            prior[k] = (7 + sum(own)) / (10 + len(own))
        for j in range(3):
            for c in (0, 1):
                total = {x: weak[c][x] + sum((p if c else 1 - p) for p, s in zip(post, spans) if s[1][j] == x) for x in "+-"}
                trust[j][c] = {x: n / sum(total.values()) for x, n in total.items()}
    want = dict(zip(spans, post))
    got = pii._estimate(counted)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_query(spark, tmp_path):
    texts = [None, "", 'x token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" y', "plain prose without anything", "mail bob@example.com, é +1 (017) 555-7713, 4111111111111111, 10.0.0.1", "jo [at] example [dot] com"] + ["write to a@b.com"] * 30
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(4, texts[4], "x")]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op1_personal_data(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        base = plain(texts[r.doc_id] or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.BASE]
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))
    by_id = {r.doc_id: r.spans for r in got}
    assert by_id[2].startswith("secret:11:51") and by_id[3] == "" and by_id[0] == ""
    weights = pii.learn(pii.find_candidates(spark.read.parquet(f"{tmp_path}/documents.parquet")))
    assert pii.redact(texts[4], weights) == "mail <EMAIL>, é <PHONE>, <CARD>, <IP>"
    empty = spark.createDataFrame([], "doc_id long, text string")
    empty.write.parquet(f"{tmp_path}/e/documents.parquet")
    assert pii.op1_personal_data(spark, f"{tmp_path}/e").count() == 0


def test_em_trusts_labelers_that_agree():
    found = pii._estimate([("secret", "++01", 500), ("secret", "-001", 40), ("email", "+++1", 300), ("email", "--01", 5)])
    assert found["secret", "++01"] > 0.9 and found["email", "+++1"] > 0.9 and found["secret", "-001"] < 0.5
