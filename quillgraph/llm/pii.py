"""Personal data: exact patterns, and a linear-chain CRF for what patterns miss.

The patterns give the base spans. The CRF labels every word of every whole text
by word-shape features of the word and its neighbours; it is trained on a small
labelled table made from templates below, and decoded by Viterbi over all texts
of a batch. Its spans come on top: those that overlap no base span and pass a
check of their kind (counts of digits, Luhn, an address's parts).
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillgraph.llm.common import columns_of, ship
from quillgraph.llm.crf import Crf
from quillgraph.llm.words import chunks, word_codes

KINDS = ("email", "ip", "card", "phone")
#: What the CRF tells apart; secrets (keys and tokens) are found besides, in columns of their own.
LABELS = ("o", *KINDS, "secret")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never starts inside a run of digits: the run's start would do as well
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _is_card(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _is_ip(text: str) -> bool:
    return all(len(x) < 4 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in text.split(".")))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns' matches that pass, leftmost first for each kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        # an address's local part reaches back as far as its characters do
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    if _DIGITS.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _is_ip(m[0])]
        out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if _is_card(m[0])]
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


# Words that stand by personal data, each a feature of its own.
CUES = "tel telephone phone call mobile cell fax ring text email mail contact write at dot (at) [at] (dot) [dot] ip address host server card visa credit order number no invoice version page id year code key token secret password api_key".split()
_SHAPE_NUMBERS = 4096
#: Numbers of a word's features: its shape, length, digits, cue word, marks (colons, dots, brackets), and the kinds of letters in a long run of them and digits.
_GROUPS = (_SHAPE_NUMBERS, 8, 8, 1 + len(CUES), 32, 8)
_RUN = "[A-Za-z0-9_+/=]{20,}"
# a shape: capitals X, small letters x, digits 9, some marks as they are; runs of letters are one, long runs of digits 9999+
_SHAPE = (("[0-9]", "9"), ("[A-ZÀ-Þ]", "X"), ("[a-zß-ɏ]", "x"), (r"[^9Xx@.+()\-:/\[\],]", "_"), ("X{2,}", "X"), ("x{2,}", "x"), ("9{5,}", "9999+"))


def _number_of(shape: str) -> int:
    number = 0
    for c in shape:
        number = (number * 131 + ord(c)) % 1_000_003
    return number % _SHAPE_NUMBERS


_OFFSETS = np.concatenate([[0], np.cumsum(_GROUPS)])
_OWN = int(_OFFSETS[-1])
#: The word's own features, then those of the word before and the word behind, with one for no such word.
N_FEATURES = 3 * _OWN + 2


def _word_features(words: pa.Array | list[str]) -> np.ndarray:
    """A row of feature numbers for each word, made over all words at once."""
    w = words if isinstance(words, pa.Array) else pa.array(words, pa.large_string())
    shape = functools.reduce(lambda x, p: pc.replace_substring_regex(x, *p), _SHAPE, w).dictionary_encode()
    numbers = np.array([_number_of(x) for x in shape.dictionary.to_pylist()], np.int64)
    digits = pc.count_substring_regex(w, "[0-9]").to_numpy().astype(np.int64)
    cue = pc.fill_null(pc.index_in(pc.utf8_trim(pc.utf8_lower(w), ".,:;!?"), pa.array(CUES, w.type)), -1).to_numpy().astype(np.int64)
    count = lambda x: np.minimum(3, pc.count_substring(w, x).to_numpy().astype(np.int64))
    has = lambda x: pc.match_substring_regex(w, x).to_numpy(zero_copy_only=False)
    bracket = has(r"[\[(]")
    mixed = has(_RUN) * (1 + has("[0-9]") + 2 * has("[a-z]") + 4 * has("[A-Z]") - has("[0-9]") * has("[a-z]") * has("[A-Z]"))
    columns = (numbers[shape.indices.to_numpy()], np.minimum(7, pc.utf8_length(w).to_numpy() // 3), np.minimum(7, digits // 2 + (digits > 0)), 1 + cue, count(":") + 4 * count(".") + 16 * bracket, mixed)
    return np.stack(columns, 1).astype(np.int64).reshape(-1, len(_GROUPS)) + _OFFSETS[: len(_GROUPS)]


def _sequence_features(words: list[str]) -> np.ndarray:
    own = _word_features(words)
    before, behind = np.full_like(own, 3 * _OWN), np.full_like(own, 3 * _OWN + 1)
    before[1:], behind[:-1] = own[:-1] + _OWN, own[1:] + 2 * _OWN
    return np.hstack([own, before, behind])


def labelled_table(rows: int = 1200, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """The small labelled table: sentences of made-up words with made-up personal data and look-alikes."""
    rng = np.random.default_rng(seed)
    letters = list("aeiourtnslmdhkgbp")
    word = lambda: "".join(rng.choice(letters, rng.integers(2, 9)))
    num = lambda n: "".join(rng.choice(list("0123456789"), n))

    def phone() -> str:
        return [
            f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"({num(3)}) 555-{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"00{num(2)} {num(3)} {num(7)}",
        ][rng.integers(7)]

    def email() -> str:
        at, dot = [("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]"), ("(at)", "dot")][rng.integers(4)]
        gap = "" if at[0] in "([" and dot[0] in "([" and rng.random() < 0.4 else " "
        return gap.join([word(), at, word(), dot, ["com", "org", "net", "de"][rng.integers(4)]])

    def card() -> str:
        x = "4" + num(14)
        x += str(next(d for d in range(10) if luhn(x + str(d))))
        return ".".join([x[:4], x[4:8], x[8:12], x[12:]])

    def ip() -> str:
        four = [str(rng.integers(0, 256 if rng.random() < 0.6 else 20)) for _ in range(4)]
        hexes = lambda n: ["".join(rng.choice(list("0123456789abcdef"), rng.integers(1, 5))) for _ in range(n)]
        return [
            ":".join("".join(rng.choice(list("0123456789abcdef"), 4)) for _ in range(8)), ":".join(hexes(8)), ":".join(hexes(rng.integers(2, 4))) + "::" + ":".join(hexes(rng.integers(2, 4))), ":".join(hexes(4)).upper() + "::" + hexes(1)[0].upper(),
            "[.]".join(four), "(.)".join(four), " dot ".join(four), ".".join(four[:2]) + "[.]" + "[.]".join(four[2:]), ".".join(four[:3]) + "[.]" + four[3], "[dot]".join(four), " (dot) ".join(four),
        ][rng.integers(11)]

    def secret() -> str:
        pick = lambda some, lo, hi: "".join(rng.choice(list(some), rng.integers(lo, hi)))
        lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
        n = [32, 40, 64][rng.integers(3)]
        made = [
            pick("0123456789abcdef", n, n + 1), pick("0123456789ABCDEF", n, n + 1), pick(lower + upper + digits + digits, 24, 45), pick(lower + upper + digits + "+/", 30, 50) + "=", f"{['sk', 'key', 'tok', 'api'][rng.integers(4)]}_{pick(lower + upper + digits + digits, 20, 40)}", "AK" + pick(upper + digits + digits, 18, 19),
        ][rng.integers(6)]
        return f'"{made}"' if rng.random() < 0.3 else made

    def decoy() -> str:
        return [
            "".join(word() for _ in range(6)), f"{num(24)}", "-".join("".join(rng.choice(list("0123456789abcdef"), k)) for k in (8, 4, 4, 4, 12)), f"www.{word()}.org/{word()}/{word()}",
            f"{num(2)}:{num(2)}:{num(2)}", f"{word()}::{word()}", ":".join("".join(rng.choice(list("0123456789abcdef"), 2)) for _ in range(6)), f"{word()}: {num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{word()} [{num(2)}]", f"{num(1)} dot {num(1)}",
            num(rng.integers(1, 9)), num(16), f"{num(2)}.{num(2)}.{num(4)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(1)}.{num(1)}.{num(1)}", f"{num(3)},{num(3)}", f"{num(2)}:{num(2)}", f"{num(3)}-{num(2)}", f"${num(3)}.{num(2)}", "$$$", "***", f"{word()} at {word()}", f"{word()}, {word()}", f"{word()}.{word()}",
            f"no {num(8)}", f"invoice {num(10)}", f"version {num(1)}.{num(2)}", f"page {num(3)}", f"({num(4)})", f"{num(4)} {num(4)}", word().upper() + "!!", f"id {num(12)}", f'"{num(40)}"', f"{word()}@{num(2)}", f"{word()}|{word()}", "| " + word(),
        ][rng.integers(37)]

    out = []
    for _ in range(rows):
        words: list[str] = []
        labels: list[int] = []

        def add(text: str, label: int, words: list[str] = words, labels: list[int] = labels) -> None:
            some = text.split()
            words += some
            labels += [label] * len(some)

        for part in range(rng.integers(1, 5)):
            if part or rng.random() < 0.8:  # some texts begin with what is to be found
                add(" ".join(word().capitalize() if rng.random() < 0.1 else word() + ("," if rng.random() < 0.1 else "") for _ in range(rng.integers(1, 7))), 0)
            kind = rng.integers(12)
            if kind < 2:
                if rng.random() < 0.6:
                    add(["call", "phone:", "tel.", "Tel:", "mobile", "fax"][rng.integers(6)], 0)
                add(phone() + [".", ",", "", ""][rng.integers(4)], LABELS.index("phone"))
            elif kind in (2, 5):
                if rng.random() < 0.3:
                    add(["mail", "contact:", "email:", "write to", "to"][rng.integers(5)], 0)
                add(email() + [".", ""][rng.integers(2)], LABELS.index("email"))
            elif kind == 3 and rng.random() < 0.5:
                add("card", 0)
                add(card(), LABELS.index("card"))
            elif kind == 4:
                if rng.random() < 0.5:
                    add(["host", "ip", "IP", "address", "server", "from"][rng.integers(6)], 0)
                add(ip() + [".", ",", "", ""][rng.integers(4)], LABELS.index("ip"))
            elif kind == 6:
                if rng.random() < 0.5:
                    add(["key", "token", "secret:", "password:", "api_key =", "key:"][rng.integers(6)], 0)
                add(secret() + [".", ",", "", ""][rng.integers(4)], LABELS.index("secret"))
            else:
                add(decoy(), 0)
        if rng.random() < 0.8 or not words:
            add(word() + ".", 0)
        out.append((words, labels))
    return out


@functools.cache
def trained_crf() -> Crf:
    table = labelled_table()
    return Crf.trained([_sequence_features(w) for w, _ in table], [np.array(y) for _, y in table], N_FEATURES, len(LABELS), steps=60)


def _passes(kind: int, text: str) -> bool:
    digits = len(_DIGITS.findall(text))
    if kind == 4:
        return 9 <= digits <= 15 and not re.search(r"[A-Za-z]", text)
    if kind == 3:
        return 13 <= digits <= 19 and luhn("".join(_DIGITS.findall(text))) and not re.search(r"[A-Za-z]", text)
    if kind == 1:
        return bool(re.fullmatch(r"[\w.%+-]+\s*(?:@|[(\[]\s*at\s*[)\]]|at)\s*[\w-]+(?:\s*(?:\.|[(\[]\s*dot\s*[)\]]|dot)\s*[\w-]+)+", text, re.I)) and bool(re.search(r"[(\[]|\bdot\b", text))
    if kind == 5:
        return bool(re.fullmatch(_RUN, text)) and digits >= 2 and len(re.findall("[A-Za-z]", text)) >= 3 and len(set(text)) >= 10
    return kind == 2 and _is_address(text)


_NAMED_DOT = r"\s*(?:\[\.\]|\(\.\)|[\[(]\s*dot\s*[\])]|\s+dot\s+|\.)\s*"
_DEFANGED = re.compile(rf"([0-9]{{1,3}}){_NAMED_DOT}([0-9]{{1,3}}){_NAMED_DOT}([0-9]{{1,3}}){_NAMED_DOT}([0-9]{{1,3}})", re.I)


def _is_address(text: str) -> bool:
    """An IPv6 address of three colons or more, or an IPv4 one whose dots are spelled out or put in brackets."""
    if m := _DEFANGED.fullmatch(text):
        return all(int(x) <= 255 for x in m.groups())
    if text.count(":") < 3 or not re.fullmatch(r"[0-9A-Fa-f:.]+", text) or not _DIGITS.search(text):
        return False
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


def crf_spans(texts: pa.Array, crf: Crf) -> list[list[tuple[int, int, int]]]:
    """Per text (null: none) the CRF's spans (label less 1, start, end) that pass their kind's check."""
    codes, vocabulary, starts = word_codes(texts)
    f = _word_features(vocabulary)
    emit = crf.emit.astype(np.float32)
    own, before, behind = emit[f].sum(1), emit[f + _OWN].sum(1), emit[f + 2 * _OWN].sum(1)
    scores = own[codes]
    if len(codes):
        scores[1:] += before[codes[:-1]]
        scores[:-1] += behind[codes[1:]]
        full = np.diff(starts) > 0
        first, last = starts[:-1][full], starts[1:][full] - 1
        inner = first[first > 0]
        scores[inner] -= before[codes[inner - 1]]
        inner = last[last < len(codes) - 1]
        scores[inner] -= behind[codes[inner + 1]]
        # a missing neighbour counts once for each of its features
        scores[first] += len(_GROUPS) * emit[3 * _OWN]
        scores[last] += len(_GROUPS) * emit[3 * _OWN + 1]
    crf32 = Crf(crf.emit, crf.move.astype(np.float32), crf.begin.astype(np.float32))
    labels = crf32.decoded(scores, starts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(starts) - 1)]
    found = np.flatnonzero(labels)
    for i in np.unique(np.searchsorted(starts, found, "right") - 1):
        text = texts[int(i)].as_py()
        own_labels = labels[starts[i] : starts[i + 1]]
        places = [m.span() for m in _WORD.finditer(text)]
        cut = np.flatnonzero(np.diff(own_labels)) + 1
        for a, b in zip([0, *cut], [*cut, len(own_labels)], strict=True):
            if kind := int(own_labels[a]):
                start, end = places[a][0], places[b - 1][1]
                piece = text[start:end]
                start, end = start + len(piece) - len(piece.lstrip(".,;:!?\"'<")), end - len(piece) + len(piece.rstrip(".,;:!?\"'>"))
                if kind == 5 and (m := re.search(_RUN, text[start:end])):
                    start, end = start + m.start(), start + m.end()
                if start < end and _passes(kind, text[start:end]):
                    out[i].append((kind - 1, start, end))
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, secrets, n_found.

    Spans are kind:start:end in code points, end exclusive, by kind and start,
    comma-joined; counts by kind and digest are those of the base patterns, spans
    and n_spans have the CRF's spans, too; secrets has start:end of keys and tokens,
    n_found counts them with the spans. Null and empty texts have none. Repeated rows give
    repeated rows.
    """
    ship(docs.sparkSession)
    crf = trained_crf()
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "secrets", "n_found"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
        for b in chunks(batches):
            text = b.column("text")
            counts, digests, spans, n_spans, secrets, n_found = [], [], [], [], [], []
            for t, more in zip(text, crf_spans(text, crf), strict=True):
                base = base_spans(t.as_py() or "")
                counts.append([sum(k == i for k, _, _ in base) for i in range(4)])
                digests.append(hashlib.sha256(said(sorted(base)).encode()).hexdigest())
                new = [x for x in more if all(x[2] <= a or e <= x[1] for _, a, e in base)]
                kept = [x for x in new if x[0] < len(KINDS)]
                spans.append(said(sorted(base + kept)))
                n_spans.append(len(base) + len(kept))
                secrets.append(",".join(f"{a}:{e}" for k, a, e in new if k == len(KINDS)))
                n_found.append(len(base) + len(new))
            counts = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(counts[:, i]) for i in range(4)], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(n_spans, pa.int64()), pa.array(secrets, pa.string()), pa.array(n_found, pa.int64())], names=names)

    return columns_of(docs, doc_id="bigint", text="string").mapInArrow(find, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint, secrets string, n_found bigint")
