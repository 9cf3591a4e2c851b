"""Personal data by aggregated weak labels.

Four kinds of spans are fixed by pattern: email, ip, card and phone. For four more (``ADDED``) loose
patterns only propose candidates. Labelers by regular expression, checksum, gazetteer, context and
neighbourhood vote on each: for (1), against (-1) or not at all (0). Expectation-maximisation over the
counts of vote patterns of the whole corpus estimates, per kind, how the labelers vote on true and false
spans, with no label given. Its posteriors are the targets of a logistic classifier over features of the
span, which decides: a candidate is added where its score is ``CUT`` or more and two labelers are for it.

Only counts of patterns come to the driver: at most 3**5 votes by 2**10 features of four kinds, in
practice a few hundred. Texts are read once, in whole; all patterns take time linear in the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import map_batches, materialize, work_dir

BASE, ADDED = ("email", "ip", "card", "phone"), ("secret", "iban", "contact", "number")
KINDS = BASE + ADDED
LABELERS = ("shape", "check", "gazetteer", "context", "neighbours")
FEATURES = ("cue", "doubt", "assigned", "quoted", "mixed", "hex", "long", "digits", "glued", "letters")
#: Score from which on a candidate is added, and labelers that must be for it.
CUT, SUPPORT = 0.9, 2

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGNED = re.compile(r"[=:][ \t]{0,3}[\"'`]?(?P<v>[^\s\"'`=:]{8,})")
TOKEN = re.compile(r"(?<![A-Za-z0-9_/+-])(?P<v>[A-Za-z0-9_/+-]{32,})")
IBAN = re.compile(r"(?<![A-Za-z0-9])(?P<v>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
AT = re.compile(r" ?[\[(] ?(?:at|AT) ?[\])] ?(?=[A-Za-z0-9])")
DOTTED = re.compile(r"[A-Za-z0-9-]+(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]+)+")
NUMBER = re.compile(r"(?<![0-9A-Za-z.,])(?P<v>\(?[0-9][0-9() ./-]{6,}[0-9])(?![0-9A-Za-z])")
GROUPED, DATED = re.compile(r"\(?0?[0-9]{2,4}\)?[ /-][0-9]{3,4}(?:[ -]?[0-9]{2,4})+"), re.compile(r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}")
WORDS = re.compile(r"[^\W\d_]+")

#: Words before a span that speak for its kind, and words that speak against any.
CUES = {
    "secret": frozenset("token password passwd passphrase pwd secret key apikey auth bearer credential credentials passwort kennwort contraseña clave mot passe jeton".split()),
    "iban": frozenset("iban account konto cuenta compte bank banco banque".split()),
    "contact": frozenset("mail email e contact kontakt contacto write schreiben escribir écrire correo courriel".split()),
    "number": frozenset("tel phone telephone mobile cell fax call telefon handy anruf teléfono móvil llamar téléphone portable appeler".split()),
}
DOUBTS = frozenset("version license licence isbn issn page pages order date year chapter section seite datum jahr página fecha año page date année http https url".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that do not overlap: at each ``@`` all that may precede it, back to the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the kinds that are fixed by pattern, by kind and start."""
    out = [(0, *s) for s in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


def proposals(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) that may be personal data, of the added kinds in their order."""
    for pattern in (ASSIGNED, TOKEN):
        yield from ((4, *m.span("v")) for m in pattern.finditer(text))
    yield from ((5, *m.span("v")) for m in IBAN.finditer(text))
    end = 0
    for m in AT.finditer(text):
        start = m.start()
        while start > end and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < m.start() and (d := DOTTED.match(text, m.end())):
            yield 6, start, (end := d.end())
    yield from ((7, *m.span("v")) for m in NUMBER.finditer(text))


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def iban_holds(value: str) -> bool:
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def judge(text: str, kind: int, start: int, end: int) -> tuple[list[int], list[bool]]:
    """The labelers' votes on a span and its features."""
    name, value = KINDS[kind], text[start:end]
    before, after = text[max(0, start - 60) : start], text[end : end + 1]
    near = {w.lower() for w in WORDS.findall(before)[-3:]}
    digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    cue, doubt = bool(near & CUES[name]), bool(near & DOUBTS)
    quoted = bool(after) and after in "\"'`" and before.endswith(after)
    assigned = before.rstrip(" \t\"'`").endswith(("=", ":"))
    glued = bool(before) and (before[-1].isalnum() or before[-1] in "/@\\") or bool(after) and (after.isalnum() or after in "/@\\")
    mixed, address = digits > 0 and letters > 0, "//" in value or value.startswith("/") or value.count("/") > 2
    if name == "secret":
        shape = 1 if mixed and len(value) >= 16 and digits >= 3 else -1
        check = 1 if len(value) >= 16 and mixed and entropy(value) >= 3 else -1
    elif name == "iban":
        shape, check = 1, 1 if iban_holds(value) else -1
    elif name == "contact":
        shape, check = 1, 1 if value[-1].isalpha() else -1
    else:
        shape = -1 if DATED.fullmatch(value) else 1 if GROUPED.fullmatch(value) else 0
        check = 1 if 9 <= digits <= 12 else -1
    votes = [shape, check, -1 if doubt and not cue else int(cue), 1 if assigned and (quoted or cue) else 0, -1 if glued or address else 0]
    return votes, [cue, doubt, assigned, quoted, mixed, not re.search("[^0-9A-Fa-f]", value), len(value) >= 32, 10 * digits >= 6 * len(value), glued or address, digits == 0]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, votes, features) of proposals that meet no fixed span and no earlier proposal."""
    taken = sorted(s[1:] for s in base)
    starts = np.array([s for s, _ in taken], np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else starts
    out, last = [], -1
    for kind, start, end in sorted(set(proposals(text)), key=lambda s: (s[1], s[0], -s[2])):
        before = int(np.searchsorted(starts, end)) - 1
        if start < last or (before >= 0 and reach[before] > start):
            continue
        votes, features = judge(text, kind, start, end)
        out.append((kind, start, end, sum((v + 1) * 3**i for i, v in enumerate(votes)), sum(f << i for i, f in enumerate(features))))
        last = end
    return sorted(out)


def unpacked(codes: np.ndarray) -> np.ndarray:
    """Votes (0 against, 1 none, 2 for) of packed patterns, a column for each labeler."""
    return np.stack([codes // 3**i % 3 for i in range(len(LABELERS))], axis=1)


@dataclass(frozen=True)
class Reliability:
    """Shares of true spans, and of each vote by class (false, true) and labeler."""

    prior: float
    votes: np.ndarray

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        patterns = unpacked(codes)
        log = np.log(np.array([1 - self.prior, self.prior]))[:, None] + sum(np.log(self.votes[:, i, patterns[:, i]]) for i in range(len(LABELERS)))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> Reliability:
    """Expectation-maximisation over counted vote patterns of one kind, from the majority of votes on."""
    patterns = unpacked(codes)
    true = 1 / (1 + np.exp(-2.0 * (patterns - 1).sum(axis=1)))
    model = None
    for _ in range(rounds):
        weight = np.stack([counts * (1 - true), counts * true])
        votes = np.stack([[np.bincount(patterns[:, i], w, 3) + 0.5 for i in range(len(LABELERS))] for w in weight])
        model = Reliability(float((weight[1].sum() + 1) / (counts.sum() + 2)), votes / votes.sum(axis=2, keepdims=True))
        now = model.posterior(codes)
        if np.abs(now - true).max() < 1e-9:
            break
        true = now
    return model


def design(kinds: np.ndarray, features: np.ndarray) -> np.ndarray:
    """A column for each kind, and for each kind and feature."""
    kind = (kinds[:, None] == np.arange(len(BASE), len(KINDS))).astype(float)
    bits = (features[:, None] >> np.arange(len(FEATURES)) & 1).astype(float)
    return np.concatenate([kind, (kind[:, :, None] * bits[:, None, :]).reshape(len(kinds), -1)], axis=1)


def fit_classifier(x: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model for soft targets, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (p - target)) + ridge * w
        curve = (x * (counts * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(counted: list[tuple[int, int, int, int]]) -> np.ndarray | None:
    """Weights of the span classifier from (kind, votes, features, count) of all candidates."""
    if not counted:
        return None
    kinds, codes, features, counts = (np.array(c, np.int64) for c in zip(*sorted(counted)))
    target = np.zeros(len(kinds))
    for kind in np.unique(kinds):
        own = kinds == kind
        patterns, at = np.unique(codes[own], return_inverse=True)
        target[own] = reliabilities(patterns, np.bincount(at, counts[own])).posterior(patterns)[at]
    return fit_classifier(design(kinds, features), target, counts.astype(float))


def decide(c: Column, weights: np.ndarray | None) -> Column:
    """Whether a candidate is personal data, as a column expression of its kind, votes and features."""
    if weights is None:
        return F.lit(False)
    logit, n = F.lit(0.0), len(ADDED)
    for k in range(n):
        own = F.lit(float(weights[k]))
        for i in range(len(FEATURES)):
            own = own + F.when(c["features"].bitwiseAND(1 << i) != 0, F.lit(float(weights[n + k * len(FEATURES) + i]))).otherwise(0.0)
        logit = F.when(c["kind"] == len(BASE) + k, own).otherwise(logit)
    support = sum((F.floor(c["votes"] / 3**i) % 3 == 2).cast("int") for i in range(len(LABELERS)))
    return (logit >= math.log(CUT / (1 - CUT))) & (support >= SUPPORT)


SPAN = "struct<kind:int,start:bigint,stop:bigint>"


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` with ``base`` and ``added``, arrays of (kind as a number in ``KINDS``, start, stop) in code
    points by kind and start, one row for each row.

    Null and empty texts have no spans, repeated rows are judged each, null ids stay, other columns are not
    read. Without candidates nothing is added. Added spans overlap no fixed ones and not each other.
    """
    at, kind = work_dir(docs.sparkSession), docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
        judged = pa.struct([*span, pa.field("votes", pa.int32()), pa.field("features", pa.int32())])
        for batch in batches:
            base = [base_spans(t) if t else [] for t in batch.column(1).to_pylist()]
            more = [candidates(t, b) if t else [] for t, b in zip(batch.column(1).to_pylist(), base)]
            lists = [[[dict(zip(s.names, x)) for x in row] for row in rows] for rows, s in ((base, span), (more, judged))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists[0], pa.list_(span)), pa.array(lists[1], pa.list_(judged))], ["doc_id", "base", "candidates"])

    schema = f"doc_id {kind}, base array<{SPAN}>, candidates array<struct<kind:int,start:bigint,stop:bigint,votes:int,features:int>>"
    found = materialize(docs.select(id_col, text_col).transform(map_batches, scan, schema), f"{at}/spans")
    counted = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count("*").alias("n"))
    weights = train([tuple(r) for r in counted.collect()])
    added = F.transform(F.filter("candidates", lambda c: decide(c, weights)), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")))
    return found.select("doc_id", "base", added.alias("added"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def personal_data_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, the numbers of fixed spans of each kind, ``base_sha256`` of them and all
    ``spans``; ``n_added`` is the number of those that the classifier added."""
    found = personal_spans(docs, id_col, text_col)
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``[kind]`` in place of each span of their text; of spans that overlap the
    first, then the longest counts. Ids must tell rows apart; rows without id or text stay as they are."""
    spans = personal_spans(docs.where(F.col(id_col).isNotNull()), id_col, text_col).select(F.col("doc_id").alias("_of"), F.concat("base", "added").alias("_spans"))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    text = F.col(text_col)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    ordered = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["kind"].alias("kind"))))
    cut = F.aggregate(
        ordered, start,
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct((-s["back"]).alias("at"), F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), names[s["kind"]]).alias("out"))),
        lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))),
    )
    joined = docs.join(spans, F.col(id_col) == F.col("_of"), "left")
    return joined.select(*[F.coalesce(cut, text).alias(c) if c == text_col else docs[c] for c in docs.columns])
