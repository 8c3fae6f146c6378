"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Strict patterns give the base spans, which always stay. Looser patterns propose further spans (spelled-out addresses, numbers
without a country prefix, defanged hosts, digit groups with other separators). On every candidate, strict ones included, labelers of three
families vote yes, no or abstain: patterns and checksums, gazetteers (domain endings, issuer and area prefixes), and context
words around the span. Votes of all documents are counted by pattern on Spark; the patterns are few, so expectation-maximisation (two
classes, one reliability table per labeler) and the logistic span classifier trained on its posteriors run on those counts. Loose spans
whose probability reaches ``ACCEPT`` and which touch no base span are added.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
#: Characters on either side of a span in which context words count.
CONTEXT = 40

# The base patterns. Possessive forms and the look-behind find the same spans without backtracking.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
# End of fixed values.

_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+ ?(?:\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\bdot\b|\.) ?[A-Za-z0-9-]{2,24}+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}+(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}+(?:(?:\[?\(?\.\)?\]?|\[dot\]|\(dot\))[0-9]{1,3}+){2}"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"),
}
# What every loose e-mail contains.
_AT = re.compile(r"\(at\)|\[at\]|\bat\b")
# A plain "at" before the end of a sentence: "look at this. It".
_PROSE = re.compile(r" at .*(?: \.|\. )")
_ENDINGS = {"com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "us", "ca"}
_NEAR = {
    "email": ("mail", "contact", "write", "reach", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "client", "from", "port"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "dial", "telefon", "anruf", "llama"),
}
_AGAINST = ("version", "token", "password", "sha", "isbn", "order", "key", "id=", "v.")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "surroundings")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part is the whole run before an @ that stands after the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > done and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base spans, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates, by start; those that touch a base span or an earlier candidate are left out."""
    found = []
    if _AT.search(text):
        found += [(m.start(), 0, m.end()) for m in _LOOSE["email"].finditer(text)]
    if _DIGIT.search(text):
        if "[" in text or "(" in text:
            found += [(m.start(), 1, m.end()) for m in _LOOSE["ip"].finditer(text)]
        found += [(m.start(), k, m.end()) for k in (2, 3) for m in _LOOSE[KINDS[k]].finditer(text)]
    taken = sorted((a, b) for a, _, b in base)
    out: list[tuple[int, int, int]] = []
    i, reach = 0, 0
    for a, k, b in sorted(found):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= reach and (i == len(taken) or taken[i][0] >= b):
            out.append((a, k, b))
            reach = b
    return out


def votes(text: str, span: tuple[int, int, int], strict: bool) -> str:
    """One character per labeler (+, -, 0), after the kind: the whole feature vector of a span."""
    a, k, b = span
    kind, s = KINDS[k], text[a:b]
    digits = _digits(s)
    near = text[max(0, a - CONTEXT) : a].lower() + " " + text[b : b + CONTEXT // 2].lower()
    if kind == "email":
        words = re.split(r"[^A-Za-z0-9]+", s.lower())
        check, gazetteer = "0", "+" if words[-1] in _ENDINGS else "-"
    elif kind == "ip":
        check = "+" if all(int(p) <= 255 for p in re.findall("[0-9]{1,3}", s)[:4]) else "-"
        gazetteer = "-" if digits[:1] == "0" else "0"
    elif kind == "card":
        check, gazetteer = "+" if luhn(digits) else "-", "+" if digits[:1] in "3456" else "-"
    else:
        check, gazetteer = "+" if 10 <= len(digits) <= 15 else "-", "+" if s[:1] == "+" or digits[:1] not in "01" else "-"
    context = "-" if any(w in near for w in _AGAINST) else "+" if any(w in near for w in _NEAR[kind]) else "0"
    edge = text[a - 1 : a] + text[b : b + 1]
    shape = "+" if strict else "-" if kind == "email" and _PROSE.search(s) else "0"
    return f"{k}{shape}{check}{gazetteer}{context}{'-' if any(c.isalnum() or c in '=\"_/' for c in edge) else '0'}"


def _candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, loose_spans(text, base)


def vote_counts(docs: DataFrame) -> dict[str, int]:
    """How often each vote pattern occurs over all documents; at most 4 * 3**5 patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    base, loose = _candidates(text)
                    seen.update(votes(text, s, True) for s in base)
                    seen.update(votes(text, s, False) for s in loose)
        yield pa.RecordBatch.from_pydict({"votes": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = docs.select("text").mapInArrow(run, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    return {r["votes"]: r["n"] for r in counted.collect()}


def fit(counts: dict[str, int], rounds: int = 40, steps: int = 400) -> dict[str, float]:
    """Probability of being personal data per vote pattern.

    Expectation-maximisation starts from the majority vote; counts are smoothed by one. No pattern gives an empty model.
    """
    keys = sorted(counts)
    if not keys:
        return {}
    n = np.array([counts[k] for k in keys], float)
    kind = np.array([int(k[0]) for k in keys])
    cast = np.array([["-0+".index(c) for c in k[1:]] for k in keys])
    yes = np.clip(0.5 + 0.2 * (cast - 1).sum(1), 0.05, 0.95)
    for _ in range(rounds):
        prior = np.array([((n * yes)[kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])[kind]
        up, down = np.log(prior), np.log(1 - prior)
        for j in range(cast.shape[1]):
            for side, w in ((0, n * yes), (1, n * (1 - yes))):
                table = np.log((np.bincount(cast[:, j], w, 3) + 1) / (w.sum() + 3))
                if side == 0:
                    up = up + table[cast[:, j]]
                else:
                    down = down + table[cast[:, j]]
        yes = 1 / (1 + np.exp(np.clip(down - up, -50, 50)))
    x = np.concatenate([np.eye(len(KINDS))[kind], *(np.eye(3)[cast[:, j]] for j in range(cast.shape[1]))], 1)
    weight, scale = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ weight))
        h = (x * (scale * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (scale * (yes - p)) - 1e-4 * weight)
        weight = weight + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(keys, (1 / (1 + np.exp(-x @ weight))).tolist()))


def find(text: str, model: dict[str, float], accept: float = ACCEPT) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    base, loose = _candidates(text)
    return base, sorted(base + [s for s in loose if model.get(votes(text, s, False), 0.0) >= accept])


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def annotate(docs: DataFrame, model: dict[str, float]) -> DataFrame:
    """Per row doc_id, counts of base spans, digest of their list, and the list of all spans. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t, model) if t else ([], []) for t in batch.column("text").to_pylist()]
            count = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            digest = [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *count, pa.array(digest), pa.array([listed(s) for _, s in found])],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    fields = ", ".join(f"n_{k} long" for k in KINDS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {fields}, base_sha256 string, spans string")


def redact(docs: DataFrame, model: dict[str, float]) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one. Null stays null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_masked(t, find(t, model)[1]) if t else t for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema).select(*names)


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, done = [], 0
    for a, k, b in spans:
        if a >= done:
            out += [text[done:a], f"<{KINDS[k].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])
