"""Personal data: rules, and a semi-Markov conditional random field for what they miss.

The rules take the leftmost match and drop it where it fails, so a phone number
with a card number beside it is lost as a whole. The field scores whole spans: a
stretch of text is cut into segments, each an entity of at most `WIDEST` tokens or
one token outside, and the cut and its types of the highest sum of span and
transition weights are found together by dynamic programming.

Outside the neighbourhood of digits, `@` and spelled-out marks no entity can
begin, so only stretches around those are decoded. The field is trained by
gradient descent on its likelihood, from spans that the rules find in a bounded
sample of documents: alone, side by side, and written in other ways.
"""

from __future__ import annotations

import json
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyloom.llm.common import share, ship, stored

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = "O"
#: Tokens of an entity at most, and numbers among them.
WIDEST, MOST_GROUPS = 40, 8
#: Documents that training spans are taken from, about; chosen by hash.
SAMPLE = 40_000
#: Spans of each kind, and stretches without any, that the field is fitted to at most.
PER_KIND = 400
#: Weight of a feature that shrinks it in each step, the rounds, and the step size.
ROUNDS, RATE, SHRINK = 6, 0.3, 1e-4
#: An added span has to be likelier than this, given its stretch.
SURE = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
#: Where an entity can be: a digit, an `@`, or `@` and `.` spelled out in brackets.
_TRIGGER = re.compile(r"[0-9]+|@|[\[({](?:at|dot)[\])}]", re.IGNORECASE)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.DOTALL)
_MARK = re.compile(r"[\[({](at|dot)[\])}]", re.IGNORECASE)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _is_card(digits: str) -> bool:
    return 16 <= len(digits) <= 19 and luhn(digits)


def _is_ip(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """What the rules find, by kind and start. Each scan is linear in the text."""
    found: list[Span] = []
    low = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
        low = domain.end() if domain else at + 1
        at = text.find("@", low)
    for m in _IP.finditer(text):
        if _is_ip(m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and _is_card(_NOT_DIGIT.sub("", m.group())):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append(("phone", *m.span()))
    return found


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words that hold a trigger, with single blanks between them."""
    start = end = -1
    for m in _TRIGGER.finditer(text):
        if m.start() < end:
            continue
        a, b = m.span()
        while a > max(end, 0) and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if _MARK.fullmatch(text, a, b):  # a mark that stands alone takes its neighbours along
            if a > 1 and text[a - 1] == " ":
                a -= 1
                while a > max(end, 0) and not text[a - 1].isspace():
                    a -= 1
            if b < len(text) - 1 and text[b] == " ":
                b += 1
                while b < len(text) and not text[b].isspace():
                    b += 1
        if end >= 0 and a <= end + 1 and text[end:a] in ("", " "):
            end = max(end, b)
            continue
        if end >= 0:
            yield start, end
        start, end = a, b
    if end >= 0:
        yield start, end


def _class(token: str) -> str:
    c = token[:1]
    if c.isdigit():
        return "9"
    if c.isalpha():
        return "a"
    return "_" if c.isspace() else c


@dataclass
class Stretch:
    """Tokens of a part of a stretch, and its segments by end: first token, label, features."""

    tokens: list[str]
    starts: list[int]
    segments: list[list[tuple[int, str, list[str]]]]


def _could_be(span: str, tokens: list[str]) -> list[str]:
    """Kinds that a span may have at all: a wide frame around what the rules ask for."""
    digits = sum(len(t) for t in tokens if t[0].isascii() and t[0].isdigit())
    kinds = []
    marked = _MARK.sub(lambda m: "@" if m[1].lower() == "at" else ".", span)
    marked = re.sub(r" ?([@.]) ?", r"\1", marked) if marked != span else span
    if marked.count("@") == 1 and " " not in marked and re.fullmatch(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+", marked):
        kinds.append("email")
    if any(c.isalpha() for c in span) or not digits:
        return kinds
    parts = re.split(r"\D+", span.strip())
    if re.fullmatch(r"[0-9]+([ ]?\.[ ]?[0-9]+){3}", span) and _is_ip(parts):
        kinds.append("ip")
    if 13 <= digits <= 19 and re.fullmatch(r"[0-9]+([ ./-][0-9]+)*", span):
        kinds.append("card")
    if 8 <= digits <= 15 and re.fullmatch(r"(\+|00)?[ ]?\(?[0-9][0-9 ()./-]*[0-9]", span) and re.search(r"[ ().+/-]", span):
        kinds.append("phone")
    return kinds


def _shape(tokens: list[str]) -> str:
    return "".join(f"{len(t)}" if _class(t) == "9" else _class(t) for t in tokens[:20])


def _span_features(kind: str, tokens: list[str], left: str, right: str, cue: str) -> list[str]:
    span = "".join(tokens)
    digits = "".join(t for t in tokens if _class(t) == "9")
    others = "".join(sorted({_class(t) for t in tokens} - {"9", "a"}))
    names = [
        "bias",
        f"shape={_shape(tokens)}",
        f"others={others}",
        f"digits={min(len(digits), 20)}",
        f"check={len(digits) > 11 and digits.isascii() and luhn(digits)}",
        f"groups={sum(_class(t) == '9' for t in tokens)}",
        f"left={left}",
        f"right={right}",
        f"cue={cue}",
        f"begin={_class(span)}",
        f"country={span[:1] == '+'}",
    ]
    return [f"{kind}|{n}" for n in names]


def _candidates(tokens: list[str], sides: list[str]) -> list[tuple[int, int, str]]:
    """Token ranges that could be an entity, by first token. Entities begin and end at the edge of a word or number."""
    n, found = len(tokens), []
    for i in range(n):
        here, left = sides[i + 1], sides[i]
        if here not in "9a+(" or (left in "9a" and here in "9a"):
            continue
        digits = groups = length = ats = marks = 0
        letters = False
        for j in range(i + 1, min(n, i + WIDEST) + 1):
            token, kind = tokens[j - 1], sides[j]
            length += len(token)
            if kind == "9":
                digits += len(token)
                groups += 1
            elif kind == "a":
                letters = True
                marks += j > i + 1 and tokens[j - 2] in "[({" and token.lower() in ("at", "dot")
            elif kind == "@":
                ats += 1
            if token[0] in "\n\r\t" or length > 320 or digits > 30 or groups > MOST_GROUPS or ats > 1:
                break
            if kind not in "9a" or sides[j + 1] in "9a" or (not (ats or marks) and (letters or digits < 4)):
                continue
            found += [(i, j, k) for k in _could_be("".join(tokens[i:j]), tokens[i:j])]
    return found


def stretch(text: str, start: int, end: int) -> Iterator[Stretch]:
    """The parts of a stretch where entities could be, with all segments and their features.

    Tokens that no entity could hold are outside in every cut, so the parts
    between them can be cut one by one.
    """
    places = [(m.start(), m.group()) for m in _TOKEN.finditer(text, start, end)]
    tokens = [t for _, t in places]
    sides = ["^", *[_class(t) for t in tokens], "$"]
    words = text[max(0, start - 40) : start].split()
    first = words[-1].lower().strip(".,;:") if words else ""
    groups: list[list[tuple[int, int, str]]] = []
    upto = -1
    for one in _candidates(tokens, sides):
        if one[0] > upto:
            groups.append([])
        groups[-1].append(one)
        upto = max(upto, one[1])
    for group in groups:
        low, high = max(0, group[0][0] - 1), min(len(tokens), max(j for _, j, _ in group) + 1)
        segments: list[list[tuple[int, str, list[str]]]] = [[] for _ in range(high - low + 1)]
        for i in range(low, high):
            own, size = sides[i + 1], min(len(tokens[i]), 20)
            features = [f"O|{own}", f"O|{own}{size}", f"O|{sides[i]}{own}{sides[i + 2]}"]
            segments[i - low + 1].append((i - low, OUTSIDE, features))
        for i, j, kind in group:
            cue = first if i == 0 else tokens[i - 2].lower() if i > 1 and sides[i - 1] == "a" else ""
            features = _span_features(kind, tokens[i:j], sides[i], sides[j + 1], cue if cue in _CUES else "")
            segments[j - low].append((i - low, kind, features))
        yield Stretch(tokens[low:high], [p for p, _ in places[low:high]], segments)


# Words that may stand before an entity.
_CUES = frozenset("tel phone call fax mobile mail email e-mail contact card visa ip host address addr server telefon téléphone teléfono".split())

_STATES = (OUTSIDE, *KINDS)


@dataclass
class Field:
    """Weights of span features and of transitions between types."""

    weights: dict[str, float]
    step: dict[str, float]

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def trellis(self, some: Stretch) -> list[list[tuple[int, str, float]]]:
        return [[(i, kind, self.score(f)) for i, kind, f in ends] for ends in some.segments]

    def best(self, some: Stretch) -> list[tuple[int, int, str]]:
        """The cut into segments `first token, token behind, kind` of the highest score, outside ones left out."""
        edges = self.trellis(some)
        top: list[dict[str, tuple[float, int, str]]] = [{"^": (0.0, 0, "")}]
        for j in range(1, len(edges)):
            here: dict[str, tuple[float, int, str]] = {}
            for i, kind, own in edges[j]:
                for last, (so_far, _, _) in top[i].items():
                    total = so_far + own + self.step.get(f"{last}>{kind}", 0.0)
                    if kind not in here or total > here[kind][0]:
                        here[kind] = (total, i, last)
            top.append(here)
        at, found = len(edges) - 1, []
        kind = max(top[at], key=lambda k: top[at][k][0])
        while at:
            _, begin, last = top[at][kind]
            if kind != OUTSIDE:
                found.append((begin, at, kind))
            at, kind = begin, last
        return found[::-1]

    def sums(self, some: Stretch) -> tuple[float, dict[tuple[int, int, str], float], dict[str, float]]:
        """Log of the sum over all cuts, and the probability of every segment and of every transition."""
        edges = self.trellis(some)
        n = len(edges) - 1
        ahead: list[dict[str, float]] = [{"^": 0.0}]
        for j in range(1, n + 1):
            here: dict[str, list[float]] = {}
            for i, kind, own in edges[j]:
                here.setdefault(kind, []).extend(v + own + self.step.get(f"{last}>{kind}", 0.0) for last, v in ahead[i].items())
            ahead.append({k: float(np.logaddexp.reduce(v)) for k, v in here.items()})
        total = float(np.logaddexp.reduce(list(ahead[n].values())))
        behind: list[dict[str, float]] = [{k: 0.0 if j == n else -np.inf for k in ahead[j]} for j in range(n + 1)]
        chance: dict[tuple[int, int, str], float] = {}
        moves: dict[str, float] = {}
        for j in range(n, 0, -1):
            for i, kind, own in edges[j]:
                for last, v in ahead[i].items():
                    name = f"{last}>{kind}"
                    rest = own + self.step.get(name, 0.0) + behind[j][kind]
                    behind[i][last] = float(np.logaddexp(behind[i][last], rest))
                    p = float(np.exp(v + rest - total))
                    chance[i, j, kind] = chance.get((i, j, kind), 0.0) + p
                    moves[name] = moves.get(name, 0.0) + p
        return total, chance, moves


def gold(some: Stretch, spans: list[Span]) -> list[tuple[int, int, str]] | None:
    """The cut that has just these spans as entities; None if a span is no possible segment."""
    begin = {s: i for i, s in enumerate(some.starts)}
    end = {s + len(t): i + 1 for i, (s, t) in enumerate(zip(some.starts, some.tokens))}
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        i, j = begin.get(a), end.get(b)
        if i is None or j is None or not any(s[:2] == (i, kind) for s in some.segments[j]):
            return None
        out += [(k, k + 1, OUTSIDE) for k in range(at, i)] + [(i, j, kind)]
        at = j
    return out + [(k, k + 1, OUTSIDE) for k in range(at, len(some.tokens))]


def train(examples: list[tuple[Stretch, list[tuple[int, int, str]]]], rounds: int = ROUNDS) -> Field:
    """Stochastic gradient ascent on the likelihood of the right cuts, with steps that adapt to each weight."""
    model = Field({}, {})
    rng = random.Random(12)
    seen: dict[str, float] = {}
    for _ in range(rounds):
        order = list(range(len(examples)))
        rng.shuffle(order)
        for e in order:
            some, right = examples[e]
            _, chance, moves = model.sums(some)
            slope: dict[str, float] = {}
            step = {name: -p for name, p in moves.items()}
            last = "^"
            for i, j, kind in right:
                step[f"{last}>{kind}"] = step.get(f"{last}>{kind}", 0.0) + 1
                last = kind
            chosen = set(right)
            for j, ends in enumerate(some.segments):
                for i, kind, features in ends:
                    g = ((i, j, kind) in chosen) - chance.get((i, j, kind), 0.0)
                    if abs(g) > 1e-4:
                        for f in features:
                            slope[f] = slope.get(f, 0.0) + g
            for table, gradient in ((model.weights, slope), (model.step, step)):
                for name, g in gradient.items():
                    g -= SHRINK * table.get(name, 0.0)
                    seen[name] = seen.get(name, 0.0) + g * g
                    table[name] = table.get(name, 0.0) + RATE * g / (1e-6 + seen[name]) ** 0.5
    return model


def _variants(kind: str, span: str, rng: random.Random) -> str:
    """A span of a kind as others write it."""
    digits = _NOT_DIGIT.sub("", span)
    if kind == "card":
        mark = rng.choice([" ", "-", ".", ""])
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "phone":
        mark = rng.choice([" ", "-", "."])
        body = mark.join([digits[-10:-7], digits[-7:-4], digits[-4:]]) if len(digits) > 10 else span
        return rng.choice([span, body, f"+{digits[:-10] or 1}{mark}{body}", f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}"])
    if kind == "email":
        name, _, host = span.partition("@")
        at, dot = rng.choice([(" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("@", "."), ("{at}", ".")])
        return f"{name}{at}{host.replace('.', dot)}"
    return span


def _number(rng: random.Random) -> str:
    """A number that is nobody's: a date, time, amount, measure, version, range, serial or book number."""
    r = rng.randint
    return rng.choice(
        [
            lambda: f"{r(1900, 2099)}-{r(1, 12):02d}-{r(1, 28):02d}",
            lambda: f"{r(1, 28):02d}.{r(1, 12):02d}.{r(1900, 2099)}",
            lambda: f"{r(1, 28)}/{r(1, 12)}/{r(1900, 2099)} {r(0, 23)}:{r(0, 59):02d}",
            lambda: f"{r(1900, 2099)}-{r(1, 12):02d}-{r(1, 28):02d} {r(0, 23):02d}:{r(0, 59):02d}:{r(0, 59):02d}",
            lambda: f"{r(1, 999)} {r(0, 999):03d} {r(0, 999):03d}",
            lambda: f"{r(1, 999)},{r(0, 999):03d},{r(0, 999):03d}.{r(0, 99):02d}",
            lambda: f"{r(0, 99)}.{r(10**7, 10**14)}",
            lambda: f"{r(1, 20)}.{r(0, 20)}.{r(0, 20)}",
            lambda: f"10.{r(1000, 9999)}/{r(100, 99999)}",
            lambda: f"97{r(8, 9)}-{r(0, 9)}-{r(10, 99)}-{r(100000, 999999)}-{r(0, 9)}",
            lambda: f"{r(1000, 9999)}-{r(1000, 9999)}",
            lambda: f"{r(1000, 2100)} {r(1000, 2100)} {r(1000, 2100)}",
            lambda: str(r(10**7, 10**17)),
        ]
    )()


def examples_of(spans: list[tuple[str, str, str]], seed: int = 34) -> list[tuple[Stretch, list[tuple[int, int, str]]]]:
    """Training stretches out of `kind, text, word before`: alone, varied, and beside each other; `O` kinds are as found."""
    rng = random.Random(seed)
    by_kind = {k: [s for s in spans if s[0] == k] for k in (*KINDS, OUTSIDE)}
    entities = [s for k in KINDS for s in by_kind[k]]
    made = []

    def add(text: str, right: list[Span]) -> None:
        for a, b in stretches(text):
            for some in stretch(text, a, b):
                low, high = some.starts[0], some.starts[-1] + len(some.tokens[-1])
                cut = gold(some, [s for s in right if s[1] < high and s[2] > low])
                if cut is not None:
                    made.append((some, cut))

    for _, text, before in by_kind[OUTSIDE]:
        add(f"{before} {text}", [])
    for _ in range(len(entities)):
        add(f"the {_number(rng)} {_number(rng)} and", [])
    for k, (kind, text, before) in enumerate(entities):
        add(f"{before} {text} and", [(kind, len(before) + 1, len(before) + 1 + len(text))])
        line, right = before + " ", []
        for _ in range(2 + k % 2):
            other, shown, _ = rng.choice(entities)
            shown = shown if rng.random() < 0.6 else _variants(other, shown, rng)
            right.append((other, len(line), len(line) + len(shown)))
            line += shown + rng.choice([" ", " ", " ", ", ", "; ", " / "])
        if rng.random() < 0.3:
            line += rng.choice(by_kind[OUTSIDE])[1] if by_kind[OUTSIDE] and rng.random() < 0.5 else _number(rng)
        add(line, right)
    return made


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field trained on spans that the rules find in about `sample` documents (`doc_id, text`).

    Of each kind at most `PER_KIND` spans count, of those that stand alone between
    words without digits, and as many stretches without any. A table without
    such spans gives a field that adds nothing.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text").where("text is not null")
    n = rows.count()
    some = rows.where(share(121, F.col("doc_id")) < F.lit(sample / max(1, n)))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, str, str, float]] = []
            for text, place in zip(batch.column("text"), batch.column("place").to_pylist()):
                text = text.as_py()
                spans = base_spans(text)
                for a, b in stretches(text):
                    inside = [s for s in spans if s[1] < b and s[2] > a]
                    if b - a > 300 or len(inside) > 1:
                        continue
                    words = text[max(0, a - 40) : a].split()
                    before = words[-1] if words else ""
                    if not inside:
                        if any(_could_be("".join(t), t) for t in (_TOKEN.findall(text[a:b].strip(".,;:")),) if t):
                            continue
                        found.append((OUTSIDE, text[a:b], before, place))
                    elif text[a:b].strip(".,;:") == text[inside[0][1] : inside[0][2]]:
                        found.append((inside[0][0], text[inside[0][1] : inside[0][2]], before, place))
            columns = list(zip(*found)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["kind", "span", "before", "place"])

    taken = some.select("text", share(122, F.col("doc_id")).alias("place")).mapInArrow(
        take, "kind string, span string, before string, place double"
    )
    taken = stored(taken, "personal-spans")
    counts = {r["kind"]: r["n"] for r in taken.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = F.lit(0.0)
    for kind, many in counts.items():  # five kinds
        least = F.when(F.col("kind") == kind, F.lit(PER_KIND / many)).otherwise(least)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = sorted({(r["place"], r["kind"], r["span"], r["before"]) for b in batches for r in b.to_pylist()})
        model = train(examples_of([s[1:] for s in spans]))
        yield pa.RecordBatch.from_pydict({"model": [json.dumps([model.weights, model.step])]})

    chosen = taken.where(share(123, F.col("kind"), F.col("span"), F.col("place")) < least)
    model = stored(chosen.coalesce(1).mapInArrow(learn, "model string"), "personal-model").first()
    return Field(*json.loads(model["model"])) if model else Field({}, {})


def _covered(spans: list[Span]) -> list[tuple[int, int]]:
    """The places of spans as ranges that don't overlap, in order."""
    out: list[tuple[int, int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _touches(covered: list[tuple[int, int]], begin: int, end: int) -> bool:
    at = bisect_left(covered, (end, -1))
    return at > 0 and covered[at - 1][1] > begin


def added_spans(text: str, base: list[Span], model: Field, sure: float = SURE) -> list[Span]:
    """Entities that the field finds and that touch none of the given spans."""
    out = []
    taken = _covered(base)
    at = 0
    for a, b in stretches(text):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        upto = bisect_left(taken, (b, -1), at)
        inside = taken[at:upto]
        if len(inside) == 1 and inside[0][0] - a < 3 and b - inside[0][1] < 3:
            continue  # nothing else in it
        for some in stretch(text, a, b):
            best = model.best(some)
            chance = model.sums(some)[1] if best else {}
            for i, j, kind in best:
                begin, end = some.starts[i], some.starts[j - 1] + len(some.tokens[j - 1])
                if chance[i, j, kind] > sure and not _touches(inside, begin, end):
                    out.append((kind, begin, end))
    return out


def found(docs: DataFrame, model: Field) -> DataFrame:
    """`doc_id, base, spans`: lists of `kind, start, end` (code points, end exclusive) of every row.

    `base` is what the rules find, `spans` that and what the field adds. Null and
    empty texts have none; a null doc_id stays null, repeated rows are told apart
    by nothing and come out alike, a very long text is one row of a task. An empty
    table gives no rows; other columns don't matter.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model if model.weights else None)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base", span), ("spans", span)])

    def rows(spans: list[Span]) -> list[dict]:
        spans = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
        return [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            base, spans = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                own = base_spans(text)
                more = added_spans(text, own, field) if field else []
                base.append(rows(own))
                spans.append(rows(own + more))
            ids = pa.concat_arrays([batch.column("doc_id")])
            yield pa.RecordBatch.from_arrays([ids, pa.array(base, span), pa.array(spans, span)], schema=schema)
            del batch

    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        scan, f"doc_id bigint, base {kind}, spans {kind}"
    )


def masked(text: str, spans: list[Span]) -> str:
    """A text with `[KIND]` in place of each span; of overlapping ones the first and longest counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: Field) -> DataFrame:
    """`doc_id, text` with the personal data of each text replaced by its kind; null stays null."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model if model.weights else None)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            texts = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                spans = base + (added_spans(text, base, field) if field and text else [])
                texts.append(masked(text, spans) if spans else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(clean, "doc_id bigint, text string")
