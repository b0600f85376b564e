"""Personal data by candidate gradient boosting.

Rules find the plain forms (e-mail, IP, card, phone); these spans always stay.
Generators of high recall propose more spans, which may overlap: written-out
addresses, IPv6 addresses, any run of 7 to 19 digits with or without separators (as a
phone and as a card), and any long run of key characters (as a secret, a kind that
the rules don't have). Most of what they propose isn't private. Boosted trees,
trained by Spark on a small labelled table that is made here from a fixed seed,
score them by features of their format and context; a threshold for each kind,
calibrated on rows that the trees haven't seen, selects those that are added. A map
over rows.

Edge cases: a null or empty text has no spans; spans are in code points of the
whole text; repeated rows are rows of their own; an empty table gives no rows;
other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .trees import predict, tree_arrays

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[int, str, int]  # start, kind, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
ANY_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for at, x in enumerate(reversed(digits)):
        value = int(x) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern: at each @, back over the local
    part, at most to the end of the match before, and on over the domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (found := DOMAIN.match(text, at + 1)):
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the plain forms, by start, then kind; failing matches are dropped, no retries."""
    out: list[Span] = [(a, "email", b) for a, b in emails(text)] if "@" in text else []
    if ANY_DIGIT.search(text):
        if "." in text:
            out += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), "card", m.end()))
        if "+" in text:
            out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


# Generators of high recall: (kind, what a text must hold, pattern).
MARKS = r"(?:@|[\[({]\s?(?:at|@)\s?[\])}]|\s(?:at|arroba|arobase)\s)"
DOTS = r"(?:\.|\s?[\[({]\s?(?:dot|\.|punkt|punto|point)\s?[\])}]\s?|\s(?:dot|punkt|punto|point)\s)"
GENERATORS = [
    ("email", re.compile("[@\\[({]|at|arroba|arobase", re.I), re.compile(rf"(?<![\w.+%-])[\w+%-](?:[\w+%-]|\.(?=[\w+%-]))*+\s?{MARKS}\s?[\w-]++(?:{DOTS}[\w-]++)+", re.I)),
    ("ip", re.compile(":.*:", re.S), re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4})?(?::[0-9A-Fa-f]{1,4}){0,6}(?![0-9A-Za-z:])")),
    ("ip", re.compile(r"[\[(]\.|dot", re.I), re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:[\[(]\.[\])]|[\[( ]dot[\]) ])[0-9]{1,3}){3}(?![0-9])", re.I)),
    ("card", re.compile("[0-9].*[0-9]", re.S), re.compile(r"(?<![\w.])[0-9](?:[ ./_–-]{0,2}[0-9]){13,18}(?![\w])")),
    ("phone", re.compile("[0-9].*[0-9]", re.S), re.compile(r"(?<![\w.+-])\(?[0-9](?:[ ()./–-]{0,3}[0-9]){6,14}(?![\w])")),
    ("secret", re.compile("[0-9A-Za-z]"), re.compile(r"(?<![\w+/=-])(?=[A-Za-z_+/=-]*[0-9])[A-Za-z0-9_+/-]{16,}+={0,2}")),
]
# Words before a span that tell its kind, in the languages of the tables.
CONTEXT = {
    "email": set("mail e-mail email contact write correo courriel schreib reach".split()),
    "ip": set("ip host server address adresse ipv6 dirección client".split()),
    "card": set("card visa mastercard credit karte kreditkarte carte tarjeta amex".split()),
    "phone": set("phone tel call mobile fax cell telefon téléphone teléfono anruf ruf handy móvil portable numéro appelez llame nummer".split()),
    "secret": set("token key apikey api_key secret password passwd pwd bearer auth authorization access_key private passwort clave contraseña".split()),
}
OTHER = set("version isbn order date invoice no id part mac time score total page ref sha sha1 sha256 md5 commit digest checksum hash etag uuid build on since from eur usd price".split())
# Common ends of host names.
TLDS = set("com org net edu gov io info de fr es uk eu us ch at it nl co example test".split())
#: Kinds in the order of spans that start together.
ALL_KINDS = [*KINDS, "secret"]
DATE = re.compile(r"(?:19|20)[0-9]{2}[./ -][0-9]{1,2}[./ -][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{6}(?![0-9])")
FEATURES = [
    "kind", "digits", "length", "separators", "groups", "longest_group", "shortest_group", "luhn", "brackets", "starts_with_0", "starts_with_00", "starts_with_parenthesis", "date", "double_colon",
    "hex", "mixed_case", "digit_share", "different", "own_context", "other_context", "assigned", "quoted", "top_level", "letter_groups",
]


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a candidate."""
    span, before = text[start:end], text[max(0, start - 60) : start].lower()
    digits = NOT_DIGIT.sub("", span)
    groups = [x for x in re.split(r"[^0-9A-Za-z]+", span) if x]
    lengths = [len(x) for x in groups] or [0]
    words = re.findall(r"[\w-]+", before)[-4:]
    letters = [x for x in span if x.isalpha()]
    values = (
        ALL_KINDS.index(kind), len(digits), min(len(span), 200), len(set(re.findall(r"[^0-9A-Za-z]", span))), len(groups), max(lengths), min(lengths), len(digits) >= 12 and luhn(digits), any(x in "[({" for x in span),
        digits.startswith("0"), digits.startswith("00"), span.startswith("("), bool(DATE.match(span)), "::" in span, all(x in "0123456789abcdefABCDEF" for x in span),
        any(x.islower() for x in letters) and any(x.isupper() for x in letters), len(digits) / max(1, len(span)), len(set(span)), any(w in CONTEXT[kind] for w in words), any(w in OTHER for w in words),
        bool(re.search(r"[=:]\s*[\"']?$", before)), before[-1:] in "\"'" and bool(before), bool(groups) and groups[-1].lower() in TLDS, sum(x.isalpha() for x in groups),
    )
    return [float(x) for x in values]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Proposed spans, in any order, overlapping as they may."""
    digit = ANY_DIGIT.search(text) is not None
    return [(m.start(), m.end(), kind) for kind, mark, pattern in GENERATORS if (digit or kind == "email") and mark.search(text) for m in pattern.finditer(text)]


def labelled_candidates(rows: int = 3000, seed: int = 11) -> list[tuple[list[float], float, str]]:
    """The small labelled table: features, whether it is personal data, and the kind. Words around
    a candidate often say nothing, now and then the wrong thing."""
    draw = random.Random(seed)
    n = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    name = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(3, 9)))
    hexes = lambda k: "".join(draw.choice("0123456789abcdef") for _ in range(k))
    keys = lambda k: "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-") for _ in range(k))
    lots = lambda digits, sizes, mark: mark.join(digits[sum(sizes[:k]) : sum(sizes[: k + 1])] for k in range(len(sizes)))

    def card(private: bool) -> str:
        digits = draw.choice("3456") + n(14)
        last = next(x for x in "0123456789" if luhn(digits + x))
        digits += last if private else str((int(last) + draw.randint(1, 9)) % 10)
        return lots(digits, [4, 4, 4, 4], draw.choice([".", "/", "_", "–", "  ", " ", "-", ""]))

    def phone() -> str:
        mark = draw.choice([" ", ".", "-", "/", ""])
        return draw.choice([
            f"({n(3)}) {n(3)}-{n(4)}", lots(n(10), [3, 3, 4], mark), "0" + lots(n(9), [1, 2, 2, 2, 2], mark), f"0{n(3)}{draw.choice(' /-')}{n(draw.randint(6, 8))}", f"0{n(2)}/{n(6)}", lots("69"[draw.randrange(2)] + n(8), [2, 3, 2, 2], mark),
            lots("69"[draw.randrange(2)] + n(8), [3, 2, 2, 2], mark), "0" + n(draw.randint(9, 10)), n(10), f"{n(3)}-{n(4)}", f"00{n(2)} {n(2)} {n(6)}", f"00{n(2)}{n(9)}",
        ])

    def made(kind: str, private: bool) -> str:
        if kind == "email":
            at, dot = draw.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."), ("@", "[.]"), (" AT ", " DOT "), (" arroba ", " punto ")])
            if private:
                return f"{name()}{draw.choice(['', '.' + name(), n(2)])}{at}{name()}{dot}{draw.choice(sorted(TLDS))}"
            return draw.choice([f"{name()} at {name()}.{name()}", f"{name()} at {name()} dot {name()}", f"{name()} @ {name()}.{name()}"])
        if kind == "ip":
            if private:
                return draw.choice(["[.]".join(str(draw.randrange(256)) for _ in range(4)), ":".join(hexes(draw.randint(1, 4)) for _ in range(8)), f"2001:db8::{hexes(4)}:{hexes(3)}", f"fe80::{hexes(4)}:{hexes(2)}:{hexes(4)}"])
            return draw.choice([f"{n(2)}:{n(2)}:{n(2)}", ":".join(hexes(2) for _ in range(6)), f"{n(1)}:{n(2)}:{n(2)}:{n(2)}"])
        if kind == "card":
            return card(True) if private else draw.choice([card(False), n(14), n(16), lots(n(16), [4, 4, 4, 4], "-"), f"20{n(12)}"])
        if kind == "secret":
            if private:
                return draw.choice([hexes(32), hexes(40), hexes(40), hexes(64), keys(draw.randint(20, 48)), "AKIA" + keys(16).upper(), "ghp_" + keys(36)])
            return draw.choice([hexes(32), hexes(40), hexes(64), f"{name()}_{name()}_{name()}_{n(2)}", f"{name()}-{name()}-{name()}{n(1)}", f"/{name()}/{name()}/{name()}{n(2)}", n(draw.randint(16, 24)), f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}"])
        if private:
            return phone()
        year = draw.choice(["19", "20"]) + n(2)
        return draw.choice([f"{year}-{n(2)}-{n(2)}", f"{n(2)}.{n(2)}.{year}", f"{year}{n(4)}", f"{year}-{year}", f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", n(draw.randint(7, 15)), n(16)[:15], f"{n(1)}.{n(3)}.{n(3)}.{n(3)}", f"{n(2)} {n(3)} {n(3)}", f"{n(4)}-{n(4)}-{n(4)}", f"{n(4)}/{n(4)}"])

    own = {kind: sorted(words) for kind, words in CONTEXT.items()}
    out = []
    while len(out) < rows:
        kind, private, luck = draw.choice(ALL_KINDS), draw.random() < 0.5, draw.random()
        said = own[kind] if private else sorted(OTHER)
        if luck > 0.97:
            said = sorted(OTHER) if private else own[kind]
        word = draw.choice(said) if luck < (0.9 if kind == "secret" else 0.6) or luck > 0.97 else name()
        span = made(kind, private)
        before = f"{name()} {name()} {word}{draw.choice([' ', ' ', ': ', ' = '])}" + (quote := draw.choice(["", "", '"']))
        text = f"{before}{span}{quote} {name()}. {name()}"
        out += [(features(text, start, end, k), float(private), k) for start, end, k in candidates(text) if k == kind and start <= len(before) + 1 and end >= len(before) + len(span) - 1]
    return out


@lru_cache(maxsize=2)
def _trained(app: str, rows: int, seed: int, rounds: int, precision: float):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors
    from pyspark.sql import SparkSession

    table = labelled_candidates(rows, seed)
    fit, held = [r for k, r in enumerate(table) if k % 3], table[::3]
    frame = SparkSession.getActiveSession().createDataFrame([(Vectors.dense(x), y) for x, y, _ in fit], ["features", "label"]).coalesce(1)
    model = GBTClassifier(maxIter=rounds, maxDepth=5, maxBins=64, stepSize=0.3, seed=seed).fit(frame)
    trees = [tree_arrays(t._java_obj.rootNode()) if hasattr(t, "_java_obj") else tree_arrays(t._call_java("rootNode")) for t in model.trees]
    boosted = [(w, t) for w, t in zip(model.treeWeights, trees)]
    scores = score(boosted, np.array([x for x, _, _ in held]))
    thresholds = {}
    for kind in ALL_KINDS:  # between the lowest score from which on unseen rows are precise enough, and the next lower one
        own = sorted(((s, y) for s, (_, y, k) in zip(scores, held) if k == kind), reverse=True)
        right, best = 0, math.inf
        for n, (s, y) in enumerate(own, 1):
            right += y
            if right / n >= precision and (n == len(own) or own[n][0] < s):
                best = (s + own[n][0]) / 2 if n < len(own) else s
        thresholds[kind] = max(best, 0.5)
    return boosted, thresholds


def score(boosted: list, rows: np.ndarray) -> np.ndarray:
    """Probabilities by the boosted trees."""
    margin = sum(w * predict(t, rows) for w, t in boosted)
    return 1 / (1 + np.exp(-2 * margin))


def train(spark, rows: int = 3000, seed: int = 11, rounds: int = 15, precision: float = 0.97):
    """The boosted trees and each kind's threshold, trained by Spark once for each application."""
    return _trained(spark.sparkContext.applicationId, rows, seed, rounds, precision)


def all_spans(text: str, base: list[Span], boosted: list, thresholds: dict[str, float]) -> list[Span]:
    """Base spans and the candidates that were selected: the best first, none that
    overlaps another span."""
    proposed = candidates(text)
    if not proposed:
        return base
    scores = score(boosted, np.array([features(text, a, b, kind) for a, b, kind in proposed]))
    merged: list[tuple[int, int]] = []
    for start, _, end in sorted(base):  # base spans of different kinds may overlap
        if merged and start < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    out = list(base)
    for s, (start, end, kind) in sorted(zip(scores, proposed), key=lambda x: (-x[0], x[1])):
        if s < thresholds[kind]:
            continue
        at = bisect_right(merged, (start, math.inf))
        if (at and merged[at - 1][1] > start) or (at < len(merged) and merged[at][0] < end):
            continue
        merged.insert(at, (start, end))
        out.append((start, kind, end))
    return sorted(out, key=lambda s: (s[0], ALL_KINDS.index(s[1]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def found(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans
    (all, as kind:start:end by start, then kind)."""
    boosted, thresholds = train(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                base = base_spans(text or "")
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans(text or "", base, boosted, thresholds))))
            made = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
            made.insert(0, id_column, frame["id"])
            yield made

    small_batches(docs.sparkSession)
    schema = f"`{id_column}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInPandas(compute, schema)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or spans that overlap, as the first one's kind in brackets."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with redacted texts (nulls stay) and, where they have it, n_chars of the new text.
    Repeated rows are rows of their own; an empty table gives no rows; other columns stay as they are."""
    boosted, thresholds = train(docs.sparkSession)

    def one(text):
        if text is None:
            return None
        spans = all_spans(text, base_spans(text), boosted, thresholds)
        return redact(text, spans) if spans else text

    def change(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([one(x) for x in texts], dtype=object)

    small_batches(docs.sparkSession)
    out = docs.withColumn(text_column, F.pandas_udf(change, "string")(F.col(f"`{text_column}`")))
    return out.withColumn("n_chars", F.length(text_column).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark, sf_dir: str) -> DataFrame:
    return found(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
