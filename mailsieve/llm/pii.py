"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Each text is scanned once for candidate spans: the base patterns of four kinds (email, ip, card, phone), and
looser forms of the same kinds (spelled-out addresses, national phone numbers, shorter cards, long ip
forms). Labelers vote yes, no or nothing on each candidate: patterns for its form, gazetteers of domain
endings, card issuers and area codes, and context labelers that read the words before it and the
characters around it. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler
is for each kind and how likely each pattern is personal data, without any labels. A logistic regression over the
span's own features learns from those likelihoods and gives the verdict on every candidate. Base spans
stay whatever the verdict.

Counts of (kind, votes, features) are all that reaches the driver; each part has a fixed, small set of values.

Defined cases: spelled-out addresses may have letters of any case and parts of any length, and their "at" and "dot" stand between blanks or in
brackets of any kind; null and empty texts have no spans; a null doc_id is reported as null; repeated rows are
each reported and counted; with no candidates at all no span is added; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsieve.operators.durable import durable

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive forms match the same text without rescanning it.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

# Looser forms of the same kinds.
LOOSE = {
    # From the edge of a run, of any length, so each run is read once.
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:[(\[{][aA][tT][)\]}]|\x20[aA][tT]\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[{][dD][oO][tT][)\]}]|\x20[dD][oO][tT]\x20|\.)\x20?[A-Za-z0-9-]{2,}+)++"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
}
#: Every spelled-out address holds one of them, in letters of any case.
AT_SIGNS = ("at)", "at]", "at}", " at ")

# Gazetteers and cue words in the four languages of the texts.
ENDINGS = frozenset("com org net edu gov info biz io de fr es uk eu it nl ch at be us ca mx ar".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35")
AREAS = re.compile(r"[2-9][0-9]{2}[0-9]{7}$")
CUES = {
    "email": "mail e-mail email contact write courriel adresse schreiben correo escribir".split(),
    "ip": "ip host server address login client adresse serveur rechner servidor".split(),
    "card": "card visa credit debit mastercard carte karte kreditkarte tarjeta pago".split(),
    "phone": "call phone tel telephone fax mobile appel telefon handy anruf llamar telefono".split(),
}
OTHER_CUES = "version isbn invoice order page article section ticket serial id nr no".split()
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
CONTEXT = 40

YES, NO, NOTHING = "+", "-", "0"
#: Weights of the labelers at the start of the estimation, in the order of ``votes``.
START_WEIGHTS = np.array([1.0, 1.0, 4.0, 1.0, 1.0, 1.0])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the base pattern: the run before each @, unless it belongs to the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        # A domain holds no @, so the next one lies behind it.
        at = text.find("@", domain.end() if domain else at + 1)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(emails(text))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out["ip"].append(m.span())
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = NOT_DIGIT.sub("", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    out["phone"].append(m.span())
    return out


def loose_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[str, int, int]]:
    """Candidates outside all base spans, non-overlapping per kind."""
    taken = sorted(s for spans in base.values() for s in spans)
    starts = np.array([a for a, _ in taken])
    ends = np.maximum.accumulate(np.array([b for _, b in taken])) if taken else starts
    digits, lowered = DIGIT.search(text) is not None, text.lower()
    for kind in KINDS:
        if kind == "email":
            if not any(sign in lowered for sign in AT_SIGNS):
                continue
        elif not digits or (kind == "ip" and ":" not in text):
            continue
        for m in LOOSE[kind].finditer(text):
            before = int(np.searchsorted(starts, m.end())) if taken else 0
            if not (before and ends[before - 1] > m.start()):
                yield kind, m.start(), m.end()


def votes(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """One sign per labeler: base form, own form, checksum or range, gazetteer, cue words, surroundings."""
    span = text[start:end]
    digits = NOT_DIGIT.sub("", span)
    sign = lambda yes, no: YES if yes else NO if no else NOTHING
    if kind == "email":
        form = sign(base or "at" in span.lower(), False)
        check = sign(0 < len(span.partition("@")[0]) <= 64, len(span) > 254)
        ending = span.rpartition(".")[2].lower() if "." in span else span.split()[-1].lower()
        known = sign(ending in ENDINGS, not ending.isalpha() or len(ending) < 2)
    elif kind == "ip":
        parts = span.split(".")
        form = sign(len(parts) == 4 or span.count(":") == 7, False)
        check = sign(all(len(p) < 4 for p in parts) or ":" in span, any(len(p) > 1 and p[0] == "0" for p in parts))
        known = sign(parts[0] not in ("0", "127", "255"), parts[0] in ("0", "255"))
    elif kind == "card":
        form = sign(len(digits) in (15, 16, 19), len(digits) < 14)
        check = sign(luhn(digits), not luhn(digits))
        known = sign(ISSUERS.match(digits), len(set(digits)) < 3)
    else:
        form = sign(base or "(" in span, "." in span and "-" in span)
        check = sign(10 <= len(digits) <= 13, len(set(digits)) < 3)
        known = sign(AREAS.search(digits), digits[-10:-9] in ("0", "1"))
    before = [w.lower() for w in WORD.findall(text[max(0, start - CONTEXT) : start])][-4:]
    cue = sign(any(w in CUES[kind] for w in before), any(w in OTHER_CUES for w in before))
    left, right = text[start - 1 : start], text[end : end + 1]
    joined = left.isalnum() or right.isalnum() or left == "." or left in "=/#_" and left != ""
    return sign(base, False) + form + check + known + cue + sign(not joined and (not left or left.isspace()), joined)


def features(text: str, kind: str, start: int, end: int) -> str:
    """The span's own features, each with a few values: kind, form, digits, separators, neighbours, checks."""
    span = text[start:end]
    only = NOT_DIGIT.sub("", span)
    digits = len(only)
    shape = "@" if "@" in span else "+" if span[0] == "+" else "a" if span[0].isalpha() else "9" if span[0].isdigit() else "x"
    breaks = "".join(c for c in " .-(" if c in span)[:2] or "0"
    side = lambda c: "e" if not c else "s" if c.isspace() else "a" if c.isalnum() else "p"
    checked = "1" if kind != "card" or luhn(only) else "0"
    return "|".join((kind, shape, str(min(digits // 3, 7)), breaks, side(text[start - 1 : start]) + side(text[end : end + 1]), checked))


SCANNED = "doc_id long, base array<struct<kind:int,start:int,end:int>>, loose array<struct<kind:int,start:int,end:int>>, votes array<string>, features array<string>"


def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text: base spans, loose spans, and votes and features of both in that order."""
    place = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    strings = pa.list_(pa.string())
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            out: list[list] = [[], [], [], []]
            for text in part.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                firm = [(k, a, b) for k in KINDS for a, b in base[k]]
                loose = list(loose_spans(text, base))
                row = lambda s: [{"kind": KINDS.index(k), "start": a, "end": b} for k, a, b in s]
                every = [*((*s, True) for s in firm), *((*s, False) for s in loose)]
                values = row(firm), row(loose), [votes(text, *s) for s in every], [features(text, *s[:3]) for s in every]
                for column, value in zip(out, values):
                    column.append(value)
            arrays = [pa.array(v, t) for v, t in zip(out, (place, place, strings, strings))]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", "base", "loose", "votes", "features"])


def estimate(kinds: np.ndarray, patterns: np.ndarray, counts: np.ndarray, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(likelihood of each vote pattern, reliability of each labeler per kind) by expectation-maximisation.

    ``patterns`` holds -1, 0 and 1. Given its class a candidate's votes are taken as independent; a labeler's
    yes and no have a rate of their own for each class and kind. The start is a vote in which a checksum or
    range that fails outweighs the others.
    """
    n = patterns.shape[1]
    likely = 1 / (1 + np.exp(-(patterns * START_WEIGHTS[:n]).sum(axis=1)))
    rates = np.zeros((len(KINDS), n, 2))
    for _ in range(steps):
        before = likely.copy()
        for k in range(len(KINDS)):
            mine = kinds == k
            if not mine.any():
                continue
            w, p, q = counts[mine].astype(float), patterns[mine], likely[mine]
            # One imagined vote of each sort keeps rates off 0 and 1.
            prior = ((w * q).sum() + 1) / (w.sum() + 2)
            score = np.full(len(q), np.log(prior / (1 - prior)))
            for j in range(n):
                for sign in (1, 0, -1):
                    told = p[:, j] == sign
                    yes = ((w * q)[told].sum() + 1) / ((w * q).sum() + 3)
                    no = ((w * (1 - q))[told].sum() + 1) / ((w * (1 - q)).sum() + 3)
                    score[told] += np.log(yes / no)
                voted = p[:, j] != 0
                right = (w * np.where(p[:, j] > 0, q, 1 - q))[voted].sum()
                rates[k, j] = (right + 1) / (w[voted].sum() + 2), w[voted].sum() / w.sum()
            likely[mine] = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(likely - before).max(initial=0.0) < 1e-6:
            break
    return likely, rates


@dataclass
class Classifier:
    """Logistic regression over one-hot feature parts."""

    weights: dict[str, float]

    def score(self, features_: str) -> float:
        total = self.weights.get("", 0.0) + sum(self.weights.get(p, 0.0) for p in parts(features_))
        return 1 / (1 + np.exp(-total))


def parts(features_: str) -> list[str]:
    kind, shape, digits, breaks, sides, checked = features_.split("|")
    own = (shape, f"d{digits}", f"b{breaks}", f"l{sides[0]}", f"r{sides[1]}", f"c{checked}")
    return [kind, *(f"{kind}|{p}" for p in own)]


def train(names: list[str], target: np.ndarray, counts: np.ndarray, ridge: float = 1.0, steps: int = 50) -> Classifier:
    """Newton's method on soft targets, each row weighted by its count."""
    columns = sorted({p for f in names for p in parts(f)} | {""})
    x = np.zeros((len(names), len(columns)))
    for i, f in enumerate(names):
        x[i, [columns.index(p) for p in ("", *parts(f))]] = 1
    w = np.zeros(len(columns))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (p - target)) + ridge * w
        bend = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, gradient)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(dict(zip(columns, w.tolist())))


def fit(scanned: DataFrame) -> tuple[Classifier, np.ndarray]:
    """The classifier and the labelers' reliabilities from a scanned table."""
    rows = scanned.select(F.explode(F.arrays_zip("votes", "features")).alias("c")).groupBy("c.votes", "c.features").count().toPandas()
    if not len(rows):
        return Classifier({"": -30.0}), np.zeros((len(KINDS), 0, 2))
    rows = rows.sort_values(["votes", "features"]).reset_index(drop=True)
    kinds = np.array([KINDS.index(f.split("|")[0]) for f in rows["features"]])
    patterns = np.array([[{YES: 1, NO: -1}.get(c, 0) for c in v] for v in rows["votes"]])
    counts = rows["count"].to_numpy(float)
    likely, rates = estimate(kinds, patterns, counts)
    return train(list(rows["features"]), likely, counts), rates


def decide(model: Classifier):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans")}
            for row in batch.to_pylist():
                text = lambda s: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(s))
                firm = [(s["kind"], s["start"], s["end"]) for s in row["base"]]
                more = [
                    (s["kind"], s["start"], s["end"])
                    for s, f in zip(row["loose"], row["features"][len(firm) :])
                    if model.score(f) >= 0.5
                ]
                out["doc_id"].append(row["doc_id"])
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(s[0] == k for s in firm))
                out["base_sha256"].append(hashlib.sha256(text(firm).encode()).hexdigest())
                out["spans"].append(text([*firm, *more]))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.string() if c in ("base_sha256", "spans") else pa.int64()) for c in out]))

    return run


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans and all spans per row of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = durable(texts.mapInArrow(scan, SCANNED), "spans")
    model, _ = fit(scanned)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scanned.mapInArrow(lambda batches: decide(shared.value)(batches), RESULT)
