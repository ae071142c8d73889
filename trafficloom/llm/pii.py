"""Personal data by weak supervision.

Candidates are the matches of base patterns (email, ip, card, phone: kept as they
are) and of looser ones (secrets after a key name, spelt-out addresses, account
and identity numbers). Three labelers vote on every candidate, for, against or not
at all, each from evidence of its own: a regex labeler (checksum and shape of the span), a gazetteer (known
domains, number ranges, key prefixes and placeholders at the span's ends) and a context labeler (words around
the span that speak for its kind or against it, the key name that a secret needs left out). Expectation
maximisation over the counts of vote patterns, made over all documents, estimates each
labeler's reliability and a posterior per pattern; these posteriors train a logistic span
classifier over votes, kind and length, which decides about the looser candidates.
Patterns are few by construction (kinds x votes x length classes), so only their counts reach the driver.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..plans.shared import bounded_batches, materialize

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "spelt", "iban", "ssn")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOOSE = {
    "secret": re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b\s*+[=:]\s*+[\"']?([A-Za-z0-9+/_-]{8,}+)"),
    "iban": re.compile(r"\b([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b"),
    "ssn": re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
}
#: What a text must hold for a loose pattern to be tried.
HINT = {"secret": re.compile(r"[=:]"), "iban": re.compile(r"[A-Z]{2}[0-9]{2}"), "ssn": re.compile(r"[0-9]-[0-9]{2}-[0-9]")}
AT = re.compile(r"(?i) ?[\[(]at[\])] ?")
SPELT_DOMAIN = re.compile(r"(?i)[a-z0-9-]++(?: ?[\[(]dot[\])] ?[a-z0-9-]++)++")
# Gazetteers.
DOMAINS = frozenset("com org net edu gov io de fr es uk eu info".split())
KEY_PREFIXES = ("sk-", "sk_", "pk_", "ghp_", "gho_", "AKIA", "ASIA", "AIza", "xox", "eyJ", "glpat-")
PLACEHOLDERS = ("changeme", "example", "password", "placeholder", "your", "xxxx", "test", "dummy")
# Words around a span that speak for its kind, and words that speak against it.
CUES = {"email": "mail contact write reach", "ip": "ip host server address", "card": "card visa pay account", "phone": "phone tel call fax mobile", "secret": "auth login deploy config credentials export", "spelt": "mail contact write reach", "iban": "iban bank account transfer", "ssn": "ssn social security"}
DOUBTS = {"email": "example sample placeholder", "ip": "version release build section chapter", "card": "order invoice tracking serial isbn", "phone": "order invoice tracking serial", "secret": "example sample dummy placeholder fake", "spelt": "example sample placeholder", "iban": "serial order model part", "ssn": "serial order model part"}
CUES, DOUBTS = ({k: re.compile(r"(?i)\b(?:" + "|".join(v.split()) + r")\b") for k, v in table.items()} for table in (CUES, DOUBTS))
AROUND, DECIDES = 40, 0.5


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from each @ so that it stays linear."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches of a whole text, by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    first = DIGIT.search(text)
    if first is None:
        return out
    at = first.start()
    for m in IP.finditer(text, at):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text, at):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def spelt_addresses(text: str) -> list[tuple[int, int]]:
    """Addresses such as ``jo [at] site [dot] com``, found from each [at] so that it stays linear."""
    out, end = [], 0
    for m in AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        while start < m.start() and not text[start].isalnum():
            start += 1
        tail = SPELT_DOMAIN.match(text, m.end()) if start < m.start() else None
        if tail:
            out.append((start, tail.end()))
        end = tail.end() if tail else m.end()
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    found = [(kind, *m.span(1)) for kind, p in LOOSE.items() if HINT[kind].search(text) for m in p.finditer(text)]
    return found + [("spelt", a, b) for a, b in spelt_addresses(text)] if "at" in text or "AT" in text or "At" in text or "aT" in text else found


def votes(kind: str, text: str, start: int, end: int) -> str:
    """The regex, gazetteer and context labelers' votes (+, - or 0) and the length class."""
    span = text[start:end]
    if kind == "email":
        shape, listed = "+" if ".." not in span else "-", "+" if span.rpartition(".")[2].lower() in DOMAINS else "-"
    elif kind == "ip":
        address = ipaddress.ip_address(".".join(p.lstrip("0") or "0" for p in span.split(".")))
        shape, listed = "+", "-" if address.is_loopback or address.is_unspecified else "+" if address.is_global or address.is_private else "0"
    elif kind == "card":
        shape, listed = "+" if len(set(span) - {" ", "-"}) >= 4 else "-", "+" if span[0] in "3456" else "0"
    elif kind == "phone":
        shape, listed = "+" if sum(c.isdigit() for c in span) >= 9 else "0", "+" if span[1] != "0" else "-"
    elif kind == "secret":
        shape = "+" if len(set(span)) >= 8 and any(c.isdigit() for c in span) else "-"
        listed = "+" if span.startswith(KEY_PREFIXES) else "-" if span[:16].lower().startswith(PLACEHOLDERS) else "0"
    elif kind == "iban":
        moved = span.replace(" ", "")
        moved = moved[4:] + moved[:4]
        shape, listed = "+" if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else "-", "0"
    elif kind == "ssn":
        shape, listed = "-" if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else "+", "0"
    else:
        shape, listed = "+", "+" if re.split(r"\W+", span[-AROUND:])[-1].lower() in DOMAINS else "-"
    before, after = text[max(0, start - AROUND):start], text[end:end + AROUND]
    good, bad = (any(cue[kind].search(x) for x in (before, after)) for cue in (CUES, DOUBTS))
    return shape + listed + ("0" if good == bad else "+" if good else "-") + str(min(3, (end - start) // 12))


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, votes) of the base matches, then of looser ones that don't touch them."""
    base = base_spans(text)
    out = [(*s, votes(s[0], text, s[1], s[2])) for s in base]
    taken: list[tuple[int, int]] = []
    for _, a, b in sorted(base, key=lambda s: (s[1], s[2])):  # base matches of two kinds may overlap
        taken[-1:] = [(taken[-1][0], max(b, taken[-1][1]))] if taken and a < taken[-1][1] else [*taken[-1:], (a, b)]
    for kind, a, b in sorted(loose_spans(text), key=lambda s: (s[1], -s[2])):
        k = bisect_left(taken, (a, b))
        if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b):
            taken.insert(k, (a, b))
            out.append((kind, a, b, votes(kind, text, a, b)))
    return out


def _estimate(patterns: list[tuple[str, str, int]], rounds: int = 60) -> dict[tuple[str, str], float]:
    """EM over (kind, votes, count): the probability that a pattern's spans are personal data.

    A labeler's reliability is how often it votes + and - on either class; a 0 is no vote and tells nothing.
    """
    if not patterns:
        return {}
    n = np.array([p[2] for p in patterns], dtype=float)
    cast = np.array([["+-0".index(c) for c in p[1][:3]] for p in patterns])
    kind = np.array([KINDS.index(p[0]) for p in patterns])
    prior = np.full(len(KINDS), 0.7)
    # reliability[labeler, class, vote]: labelers start out better than chance; the last column is for no vote
    reliability = np.tile(np.array([[0.3, 0.7, 1.0], [0.85, 0.15, 1.0]]), (3, 1, 1))
    for _ in range(rounds):
        like = np.ones((len(n), 2)) * np.c_[1 - prior[kind], prior[kind]]
        for j in range(3):
            like *= reliability[j][:, cast[:, j]].T
        post = like[:, 1] / like.sum(1)
        for k in range(len(KINDS)):
            own = kind == k
            prior[k] = (7 + (n * post)[own].sum()) / (10 + n[own].sum())
        for j in range(3):
            for c, p in enumerate((1 - post, post)):
                counts = np.bincount(cast[:, j], weights=n * p, minlength=3)[:2] + np.array([[3, 7], [8.5, 1.5]])[c]
                reliability[j, c, :2] = counts / counts.sum()
    return {(p[0], p[1]): float(x) for p, x in zip(patterns, post)}


def _features(kind: str, vote: str) -> np.ndarray:
    x = np.zeros(len(KINDS) + 3 * 3 + 4)
    x[KINDS.index(kind)] = 1
    for j in range(3):
        x[len(KINDS) + 3 * j + "+-0".index(vote[j])] = 1
    x[len(KINDS) + 9 + int(vote[3])] = 1
    return x


def train_classifier(patterns: list[tuple[str, str, int]]) -> np.ndarray:
    """Weights of a logistic classifier over span features, fitted to the EM posteriors of all spans."""
    soft = _estimate(patterns)
    w = np.zeros(len(KINDS) + 13)
    if not soft:
        return w
    x = np.array([_features(k, v) for k, v, _ in patterns])
    n = np.sqrt(np.array([c for _, _, c in patterns], dtype=float))
    y = np.array([soft[k, v] for k, v, _ in patterns])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (n * p * (1 - p) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (n * (y - p)) - 0.1 * w)
    return w


def keeps(weights: np.ndarray, kind: str, vote: str) -> bool:
    return kind in BASE or bool(1 / (1 + np.exp(-_features(kind, vote) @ weights)) >= DECIDES)


SPANS = "array<struct<kind:string,start:int,end:int,votes:string>>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string())]))
    for b in batches:
        spans = [[{"kind": k, "start": s, "end": e, "votes": v} for k, s, e, v in candidates(t or "")] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "found"])


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and all candidate spans with their votes, one row per row of docs; null texts are empty."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_found, f"doc_id long, found {SPANS}")


def learn(found: DataFrame) -> np.ndarray:
    """The span classifier, from the vote patterns of all candidates."""
    counts = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n"))
    return train_classifier([tuple(r) for r in counts.orderBy("kind", "votes").collect()])  # kinds x votes x lengths rows at most


def _digest(weights: np.ndarray):
    def line(spans: list) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches):
        memo: dict = {}
        for b in batches:
            base, all_spans, counts = [], [], []
            for found in b.column("found").to_pylist():
                good = [(s["kind"], s["start"], s["end"]) for s in found if memo.setdefault((s["kind"], s["votes"]), keeps(weights, s["kind"], s["votes"]))]
                good.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                own = [s for s in good if s[0] in BASE]
                base.append(hashlib.sha256(line(own).encode()).hexdigest())
                all_spans.append(line(good))
                counts.append([sum(s[0] == k for s in own) for k in BASE])
            numbers = [pa.array([c[j] for c in counts], pa.int64()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *numbers, pa.array(base, pa.string()), pa.array(all_spans, pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return run


def redact(text: str | None, weights: np.ndarray) -> str | None:
    """The text with every personal span replaced by its kind in angle brackets; of spans that overlap the first wins."""
    if not text:
        return text
    out, at = [], 0
    for k, a, b, v in sorted(candidates(text), key=lambda s: (s[1], -s[2])):
        if a >= at and keeps(weights, k, v):
            out += [text[at:a], f"<{k.upper()}>"]
            at = b
        elif at > a and b > at and keeps(weights, k, v):
            at = b
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs with personal spans replaced in its text; other columns as they are."""
    bounded_batches(docs.sparkSession)
    schema = StructType([StructField(f.name, StringType()) if f.name == text_col else f for f in docs.schema])

    def run(batches):
        for b in batches:
            i = b.schema.get_field_index(text_col)
            yield b.set_column(i, text_col, pa.array([redact(t, weights) for t in b.column(i).to_pylist()], pa.string()))

    return docs.mapInArrow(run, schema)


def op1_personal_data(spark, sf_dir: str) -> DataFrame:
    """Base matches and all spans for the whole of documents: one row per row; repeated rows alike."""
    found = materialize(find_candidates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "spans")
    return found.mapInArrow(_digest(learn(found)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
