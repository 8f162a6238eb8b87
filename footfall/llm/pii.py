"""Personal data: fixed patterns, and a semi-Markov field for what they miss.

The base patterns are matched exactly. Around every digit, ``@`` or bracketed
"at", the words form zones; within a zone the field scores candidate segments of
up to ``MOST_WORDS`` words by features of the whole span (digit count, checksum,
separators, shape) together with the kind, and a dynamic program over segment
ends chooses boundaries and kinds at once. Segments that overlap no base span are
added; base spans always stay.

The weights are learned by maximum likelihood (forward-backward over segments) on
a bounded sample: at most ``SAMPLE`` zones, taken by hash, labelled by the base
patterns, plus variants of them in formats the patterns do not know.

Defined results: a null text is an empty one; positions are code points, ends
exclusive; repeated rows give repeated results; a sample without any base span
leaves the field untrained and adds nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import map_columns

KINDS = ("email", "ip", "card", "phone")
MOST_WORDS = 8
SAMPLE = 1_200
ROUNDS = 8
# Least posterior log-odds over "no entity" that an added segment needs.
MARGIN = 2.0

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMERIC = re.compile(r"[0-9+][\x20().0-9+-]*")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]")
SPACES = " \t\n\r\x0b\x0c"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _numbers(text: str):
    """Matches within runs of the only characters numeric patterns consist of."""
    for run in NUMERIC.finditer(text):
        if run.end() - run.start() < 7:
            continue
        part, base = run[0], run.start()
        for m in DOTTED.finditer(part):
            octets, at = m[0].split("."), base + m.start()
            for k in range(0, len(octets) - 3, 4):
                four = octets[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(map(_octet, four)):
                    yield "ip", at, at + size
                at += size + 1
        for m in CARD.finditer(part):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", base + m.start(), base + m.end()
        for m in PHONE.finditer(part):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                yield "phone", base + m.start(), base + m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches by start, then kind."""
    found = [*_emails(text), *_numbers(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# Zones and candidate segments


def zones(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words with a trigger, as word positions; a bracketed "at" or "dot"
    also brings the words beside it."""
    words: list[tuple[int, int, bool]] = []
    at = 0
    while found := TRIGGER.search(text, at):
        start, end = found.start(), found.end()
        floor = words[-1][1] if words else 0
        while start > floor and text[start - 1] not in SPACES:
            start -= 1
        while end < len(text) and text[end] not in SPACES:
            end += 1
        words.append((start, end, found[0][0] in "[("))
        at = end
    out: list[list[tuple[int, int]]] = []
    for start, end, bracket in words:
        own = [(start, end)]
        if bracket:
            # Neighbouring words of a spelled-out address.
            a = start - 1
            while a > 0 and text[a - 1] not in SPACES:
                a -= 1
            if 0 < start and start - a > 1 and text[start - 1] == " ":
                own.insert(0, (a, start - 1))
            z = end + 1
            while z < len(text) and text[z] not in SPACES:
                z += 1
            if end < len(text) and text[end] == " " and z - end > 1:
                own.append((end + 1, z))
        for word in own:
            if out and word[0] <= out[-1][-1][1] + 1 and not text[out[-1][-1][1] : word[0]].strip(" "):
                if word[0] > out[-1][-1][0]:
                    out[-1].append(word)
            elif not out or word[0] > out[-1][-1][1]:
                out.append([word])
    return out


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without quotes and closing punctuation around the span."""
    while start < end and text[start] in "\"'<[{":
        start += 1
    while end > start and text[end - 1] in ".,;:!?\"'>]}":
        end -= 1
    if end > start and text[end - 1] == ")" and "(" not in text[start:end]:
        end -= 1
    if end > start and text[start] == "(" and ")" not in text[start:end]:
        start += 1
    return start, end


NAMES = (
    "always", "email", "spelled email", "four octets", "card length", "card checksum", "plus", "phone length",
    "area in brackets", "three groups", "only number marks", "letters", "few digits", "many digits", "one word",
    "no digit", "long", "ends in digit",
)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]+ ?(?:@|[\[(]at[\])]) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]+)+"
)
_GROUPS = re.compile(r"(?:\+?[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")
_MARKS = re.compile(r"[\x20().0-9+-]+")


def features(span: str, words: int) -> list[float]:
    """Features of a whole candidate span."""
    digits = "".join(c for c in span if "0" <= c <= "9")
    n = len(digits)
    parts = span.split(".")
    octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and _octet(p) for p in parts)
    marks = len(span) < 400 and _MARKS.fullmatch(span) is not None
    short = len(span) < 400
    return [
        1.0,
        float(short and _EMAIL.fullmatch(span) is not None),
        float(short and _SPELLED.fullmatch(span) is not None),
        float(octets),
        float(14 <= n <= 19 and marks),
        float(14 <= n <= 19 and marks and luhn(digits)),
        float(span.startswith("+") and marks),
        float(10 <= n <= 15 and marks),
        float("(" in span and ")" in span and marks),
        float(short and _GROUPS.fullmatch(span) is not None),
        float(marks),
        float(any(c.isalpha() for c in span)),
        float(n < 7),
        float(n > 19),
        float(words == 1),
        float(n == 0),
        float(len(span) > 60),
        float(span[-1:].isdigit()),
    ]


def segments(text: str, words: list[tuple[int, int]]):
    """Candidates as (first word, word after the last, start, end) and features."""
    out, rows = [], []
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + MOST_WORDS) + 1):
            start, end = trimmed(text, words[i][0], words[j - 1][1])
            out.append((i, j, start, end))
            rows.append(features(text[start:end], j - i))
    return out, np.array(rows)


class Field:
    """Weights per kind and feature; kind 0 is "no entity", one word long."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros((len(KINDS) + 1, len(NAMES))) if weights is None else weights

    def scores(self, found, rows) -> np.ndarray:
        s = rows @ self.weights.T
        for k, (i, j, _, _) in enumerate(found):
            if j - i > 1:
                s[k, 0] = -np.inf
        return s

    def best(self, text: str, words) -> list[tuple[str, int, int]]:
        """The best segmentation; entities must beat their words by ``MARGIN``."""
        found, rows = segments(text, words)
        s = self.scores(found, rows)
        s[:, 1:] -= MARGIN
        kind = s.argmax(axis=1)
        value = [0.0] + [-np.inf] * len(words)
        back: list[int] = [0] * (len(words) + 1)
        for k in sorted(range(len(found)), key=lambda k: found[k][1]):
            i, j, _, _ = found[k]
            v = value[i] + s[k, kind[k]]
            if v > value[j]:
                value[j], back[j] = v, k
        out, j = [], len(words)
        while j:
            k = back[j]
            if kind[k]:
                out.append((KINDS[kind[k] - 1], found[k][2], found[k][3]))
            j = found[k][0]
        return out[::-1]

    def learn(self, samples, rounds: int = ROUNDS, rate: float = 0.5) -> None:
        """Gradient ascent on the likelihood of the given segmentations."""
        ready = []
        for text, words, gold in samples:
            found, rows = segments(text, words)
            place = {(a, z): k for k, (_, _, a, z) in reversed(list(enumerate(found)))}
            want = np.zeros((len(found), len(KINDS) + 1))
            covered = set()
            for kind, a, z in gold:
                k = place.get((a, z))
                if k is not None and not covered & set(range(*found[k][:2])):
                    want[k, KINDS.index(kind) + 1] = 1
                    covered |= set(range(*found[k][:2]))
            for k, (i, j, _, _) in enumerate(found):
                if j == i + 1 and i not in covered:
                    want[k, 0] = 1
            ready.append((len(words), found, rows, want))
        squares = np.full_like(self.weights, 1e-3)
        for _ in range(rounds):
            for n, found, rows, want in ready:
                s = self.scores(found, rows)
                total = np.logaddexp.reduce(s, axis=1)
                ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
                ahead[0] = behind[n] = 0.0
                for k in sorted(range(len(found)), key=lambda k: found[k][1]):
                    i, j = found[k][:2]
                    ahead[j] = np.logaddexp(ahead[j], ahead[i] + total[k])
                for k in sorted(range(len(found)), key=lambda k: -found[k][0]):
                    i, j = found[k][:2]
                    behind[i] = np.logaddexp(behind[i], behind[j] + total[k])
                ends = np.array([ahead[i] + behind[j] for i, j, _, _ in found])
                expected = np.exp(s + ends[:, None] - ahead[n])
                step = (want - expected).T @ rows - 1e-4 * self.weights
                squares += step**2
                self.weights = self.weights + rate * step / np.sqrt(squares)


def variants(kind: str, value: str) -> list[str]:
    """Other spellings of a base match, of the same kind."""
    if kind == "email":
        name, _, host = value.partition("@")
        return [f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name}(at){host}"]
    if kind == "phone":
        digits = "".join(c for c in value if c.isdigit())[-10:]
        return [f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"{digits[:3]}-{digits[3:6]}-{digits[6:]}"]
    return []


def _hides_a_match(text: str, words, inside) -> bool:
    """Whether a candidate that the patterns passed over, since they match greedily
    and do not retry, would match alone. Such zones teach nothing certain."""
    for _, _, a, z in segments(text, words)[0]:
        if not any(s[1] < z and s[2] > a for s in inside) and any(s[1:] == (0, z - a) for s in base_spans(text[a:z])):
            return True
    return False


def training_set(texts: list[str]):
    """Zones of sample texts with their base spans, and variants of these."""
    out = []
    for text in texts:
        spans = base_spans(text)
        for words in zones(text):
            inside = [s for s in spans if words[0][0] <= s[1] and s[2] <= words[-1][1]]
            if len(words) <= 40 and not _hides_a_match(text, words, inside):
                out.append((text, words, inside))
            for kind, a, z in inside:
                for other in variants(kind, text[a:z]):
                    line = f"a {other}. b"
                    for w in zones(line):
                        out.append((line, w, [(kind, 2, 2 + len(other))]))
    return out


def sample_texts(docs: DataFrame, most: int = SAMPLE) -> list[str]:
    """Bounded excerpts around zones, chosen by hash over all texts."""

    def step(batches):
        for b in batches:
            out = []
            for text in b["text"]:
                for words in zones(text or ""):
                    out.append(text[max(0, words[0][0] - 20) : words[0][0] + 300])
            yield {"text": out}

    rows = map_columns(docs.select("text"), step, "text string")
    return [r["text"] for r in rows.orderBy(F.xxhash64("text"), "text").limit(most).collect()]


def trained(docs: DataFrame, most: int = SAMPLE) -> Field:
    """A field fitted on the sample; without any base span it stays neutral."""
    samples = training_set(sample_texts(docs, most))
    field = Field()
    if any(gold for _, _, gold in samples):
        field.learn(samples)
    else:
        field.weights[0, 0] = 100.0
    return field


def all_spans(text: str, field: Field) -> tuple[list, list]:
    """Base spans, and base plus added spans, both by start and kind."""
    base = base_spans(text)
    taken = np.array([s[1:] for s in base], np.int64).reshape(-1, 2)
    added = []
    for words in zones(text):
        for kind, a, z in field.best(text, words):
            if not ((taken[:, 0] < z) & (taken[:, 1] > a)).any():
                added.append((kind, a, z))
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


FOUND = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
)


def found_spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Counts and digest of base spans and the list of all spans, per text."""
    held = docs.sparkSession.sparkContext.broadcast((field or trained(docs)).weights)

    def step(batches):
        own = Field(held.value)
        for b in batches:
            pairs = [all_spans(t or "", own) for t in b["text"]]
            yield {
                "doc_id": b["doc_id"],
                **{f"n_{k}": [sum(s[0] == k for s in base) for base, _ in pairs] for k in KINDS},
                "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in pairs],
                "spans": [joined(spans) for _, spans in pairs],
            }

    return map_columns(docs.select("doc_id", "text"), step, FOUND)


def redacted_text(text: str, spans) -> str:
    """The text with every span replaced by its kind; overlapping spans as one."""
    out, at, pending = [], 0, None
    for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if pending and a < pending[2]:
            pending = (pending[0], pending[1], max(z, pending[2]))
            continue
        if pending:
            out += [text[at : pending[1]], f"[{pending[0].upper()}]"]
            at = pending[2]
        pending = (kind, a, z)
    if pending:
        out += [text[at : pending[1]], f"[{pending[0].upper()}]"]
        at = pending[2]
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents with personal data replaced; other columns pass unchanged."""
    held = docs.sparkSession.sparkContext.broadcast((field or trained(docs)).weights)
    schema = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes)

    def step(batches):
        own = Field(held.value)
        for b in batches:
            b["text"] = [t and redacted_text(t, all_spans(t, own)[1]) for t in b["text"]]
            if "n_chars" in b:
                b["n_chars"] = [n if t is None else len(t) for n, t in zip(b["n_chars"], b["text"])]
            yield b

    return map_columns(docs, step, schema)
