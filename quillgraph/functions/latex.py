"""LaTeX parsing that needs nesting or loops: plain functions and their Arrow wrappers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CITE = re.compile(r"\\cite[a-zA-Z]*\*?\s*(?:\[[^\]]*\]\s*){0,2}\{")
_SECTION = re.compile(r"\\(?:sub)*section\*?\s*\{")
_BRACE = re.compile(r"\\.|[{}]", re.S)
_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
_DROPPED = re.compile(r"\\(?:label|ref|vspace|hspace|begin|end|footnote)\*?\s*\{[^{}]*\}")
_HEADING = re.compile(r"\\(?:sub)*section\*?\s*\{[^{}]*\}")
_STYLED = re.compile(r"\\(?:emph|text\w*|math\w*)\s*\{([^{}]*)\}")
_MACRO = re.compile(r"\\[a-zA-Z]+\*?")
_PARKED = re.compile(r"\x00(\d+)\x00")
_SENTENCE_END = re.compile(r"[.!?](\s+)(?=[A-Z\\])")
_ITEM = re.compile(r"\\bibitem(?:\s*\[[^\]]*\])?\s*\{([^}]*)\}")
_ITEM_END = re.compile(r"\\bibitem|\\end\{thebibliography\}")
_QUOTED = re.compile(r"``(.+?),?''|\"(.+?),?\"")
_EMPHASISED = re.compile(r"\\emph\{([^{}]+)\}|\{\\(?:em|it)\s+([^{}]+)\}")
_EPRINT = re.compile(r"(?i)arxiv[:\s/a-z.]*?(\d{4}\.\d{4,5})")
KEY_CAP, LENGTH_CAP = 6, 600


def balanced(text: str, at: int) -> int:
    """The place behind the brace that closes the one at `at`; the text's end where none does."""
    end = text.find("}", at)
    if end > 0 and "{" not in (inner := text[at + 1 : end]) and "\\" not in inner:
        return end + 1
    depth = 0
    for m in _BRACE.finditer(text, at):
        c = m[0]
        depth += (c == "{") - (c == "}")
        if not depth:
            return m.end()
    return len(text)


def _cites(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, trimmed keys) of all citations in order."""
    out = []
    for m in _CITE.finditer(text):
        end = balanced(text, m.end() - 1)
        out.append((m.start(), end, [k for x in text[m.end() : end - 1].split(",") if (k := x.strip())]))
    return out


def cite_keys(text: str) -> list[str]:
    """Trimmed keys of all citations in order, each once."""
    return list(dict.fromkeys(k for _, _, keys in _cites(text) for k in keys))


def sections(text: str) -> list[tuple[str, str]]:
    """(title, body) of every section, to the next one's start."""
    found = [(m.start(), m.end(), balanced(text, m.end() - 1)) for m in _SECTION.finditer(text)]
    ends = [s for s, _, _ in found[1:]] + [len(text)] * bool(found)
    return [(text[b : e - 1], text[e:end]) for (_, b, e), end in zip(found, ends, strict=True)]


def _flat_title(title: str) -> str:
    return " ".join(re.sub(r"[^a-z\s]", " ", re.sub(r"\\[a-z]+\*?", " ", title.lower())).split())


def intro_and_related(text: str, shortest: int = 50, most: int = 80_000) -> tuple[str, str]:
    """(introduction, related work); where both are short, the body up to the bibliography."""
    intro = related = ""
    for title, body in sections(text):
        t = _flat_title(title)
        if not intro and (t.startswith("introduction") or t == "intro"):
            intro = body.strip()
        if not related and any(x in t for x in ("related work", "prior work", "previous work", "literature review", "background")):
            related = body.strip()
    if len(intro) + len(related) < shortest:
        start = max((m.end() for m in re.finditer(r"\\maketitle|\\end\{abstract\}", text)), default=0)
        end = re.search(r"\\(?:bibliography\b|begin\{thebibliography\})", text[start:])
        intro = text[start : start + end.start() if end else len(text)][:most].strip()
    return intro, related


def clean_sentence(raw: str) -> tuple[str, bool, list[str]]:
    """(text, ok, what was wrong): comments, labels, environments, macros and braces go, citations stay, at most KEY_CAP keys each."""
    s = _clean_text(raw or "")
    flags = [n for n, bad in (("empty", not s), ("too_few_letters", 0 < len(s) and len(re.findall(r"[A-Za-z]", s)) < 8), ("too_long", len(s) > 900)) if bad]
    return s, not flags, flags


def _clean_text(s: str, cites: list[tuple[int, int, list[str]]] | None = None) -> str:
    """cites: _cites of s, where they are known."""
    if "%" in s:
        s, cites = _COMMENT.sub(" ", s), None
    parked: list[str] = []
    around, at = [], 0
    for start, end, keys in _cites(s) if cites is None else cites:
        if start < at:
            continue
        around.append(s[at:start])
        parked.append("\\cite{" + ",".join(keys[:KEY_CAP]) + "}")
        at = end
    around.append(s[at:])
    plain = "".join(around)
    if "\\" in plain or "\x00" in plain:
        s = "".join(f"{x}\x00{i}\x00" for i, x in enumerate(around[:-1])) + around[-1]
        # each of these needs a macro
        while "\\" in s:
            t = _STYLED.sub(r"\1", _HEADING.sub(" ", _DROPPED.sub(" ", s)))
            if t == s:
                s = _MACRO.sub(" ", s)
                break
            s = t
        s = s.replace("{", "").replace("}", "").replace("~", " ")
        s = _PARKED.sub(lambda m: parked[int(m[1])], s)
    else:
        around = [x.replace("{", "").replace("}", "").replace("~", " ") for x in around]
        s = "".join(x for pair in zip(around, [*parked, ""], strict=True) for x in pair)
    s = " ".join(s.split())
    for sign in ".,;:":
        s = s.replace(" " + sign, sign)
    if len(s) > LENGTH_CAP:
        cut = s.rfind(". ", 0, LENGTH_CAP)
        s = s[: cut + 1] if cut > 0 and s.count("\\cite", 0, cut) == s.count("\\cite") else s
    return s


def citing_sentences(text: str) -> list[tuple[str, list[str]]]:
    """(sentence, keys) of each sentence with citations; equal cleaned sentences unite their keys, all of the raw text's keys count."""
    out: dict[str, dict[str, None]] = {}
    text = text.replace("i.e.", "ie").replace("e.g.", "eg").replace("et al.", "et al")
    last, start = text.rfind("\\cite"), 0
    while start <= last:
        m = _SENTENCE_END.search(text, start)
        raw = text[start : m.start(1) if m else len(text)]
        start = m.end() if m else len(text)
        cites = _cites(raw) if "\\cite" in raw else []
        if any(keys for _, _, keys in cites) and (clean := _clean_text(raw, cites)):
            known = out.setdefault(clean, {})
            for _, _, keys in cites:
                known.update(dict.fromkeys(keys))
    return [(s, list(k)) for s, k in out.items()]


def bibitems(text: str) -> list[tuple[str, dict[str, str]]]:
    """(key, fields) of a thebibliography; the title is a quoted part, an emphasised one, or the second newblock."""
    out, at = [], 0
    while m := _ITEM.search(text, at):
        end = _ITEM_END.search(text, m.end())
        at = end.start() if end else len(text)
        body = " ".join(text[m.end() : at].split())
        fields = {"raw": body}
        blocks = body.split("\\newblock", 2)
        if quoted := ("``" in body or '"' in body) and _QUOTED.search(body):
            fields["title"] = quoted[1] or quoted[2]
        elif len(blocks) > 1:
            fields["title"] = blocks[1].strip(" .")
        elif emphasised := _EMPHASISED.search(body):
            fields["title"] = emphasised[1] or emphasised[2]
        # other letters than ASCII may count as an i there
        if ("arxiv" in body.lower() or not body.isascii()) and (x := _EPRINT.search(body)):
            fields["eprint"] = x[1]
        out.append((m[1].strip(), fields))
    return out


def bibtex_entries(text: str) -> list[tuple[str, dict[str, str]]]:
    """(key, fields) of BibTeX entries; values in braces or quotes, nested braces kept."""
    out = []
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s]+)\s*,", text):
        if m[1].lower() in ("comment", "string", "preamble"):
            continue
        end = balanced(text, text.index("{", m.start()))
        body, fields, at = text[m.end() : end - 1], {}, 0
        while f := re.compile(r"(\w[\w-]*)\s*=\s*").search(body, at):
            i = f.end()
            if i < len(body) and body[i] == "{":
                stop = balanced(body, i)
                value = body[i + 1 : stop - 1]
            elif i < len(body) and body[i] == '"':
                stop = body.find('"', i + 1) % (len(body) + 1) + 1
                value = body[i + 1 : stop - 1]
            else:
                stop = i + len(re.match(r"[^,}]*", body[i:])[0])
                value = body[i:stop].strip()
            fields[f[1].lower()] = " ".join(value.split())
            at = stop
        out.append((m[2], fields))
    return out


_DEFINITION = re.compile(r"\\(?:(?:re)?newcommand|providecommand)\*?\s*\{?\s*\\([A-Za-z]+)\s*\}?\s*(?:\[(\d)\])?\s*(?:\[[^\]]*\]\s*)?(?=\{)|\\def\s*\\([A-Za-z]+)\s*((?:#\d)*)\s*(?=\{)|\\DeclareMathOperator\*?\s*\{\s*\\([A-Za-z]+)\s*\}\s*(?=\{)")


def expanded_macros(text: str, passes: int = 2, most: int = 2_000_000) -> str:
    """A text with its own macros in place, and without their definitions.

    \\newcommand (also re-, provide-), \\def with plain arguments, and
    \\DeclareMathOperator; a macro with too few arguments stays. Bodies that name
    other macros take a further pass; a text that would grow over `most` stays as
    it was before that pass.
    """
    macros: dict[str, tuple[int, str]] = {}
    rest, at = "", 0
    for m in _DEFINITION.finditer(text):
        if m.start() < at:
            continue
        end = balanced(text, m.end())
        body = text[m.end() + 1 : end - 1]
        if m[1]:
            macros[m[1]] = (int(m[2] or 0), body)
        elif m[3]:
            macros[m[3]] = (m[4].count("#"), body)
        else:
            macros[m[5]] = (0, f"\\operatorname{{{body}}}")
        rest, at = rest + text[at : m.start()], end
    text = rest + text[at:]
    if not macros:
        return text
    call = re.compile(r"\\(" + "|".join(sorted(macros, key=len, reverse=True)) + r")(?![A-Za-z])")
    for _ in range(passes):
        out, at, size = [], 0, 0
        for m in call.finditer(text):
            if m.start() < at:
                continue
            n, body = macros[m[1]]
            end, arguments = m.end(), []
            while len(arguments) < n:
                start = len(text) - len(text[end:].lstrip(" ")) if end < len(text) and text[end] == " " else end
                if start >= len(text) or text[start] != "{":
                    break
                stop = balanced(text, start)
                arguments.append(text[start + 1 : stop - 1])
                end = stop
            if len(arguments) < n:
                continue
            made = re.sub(r"#(\d)", lambda x: arguments[int(x[1]) - 1] if 0 < int(x[1]) <= n else x[0], body)  # noqa: B023
            out += [text[at : m.start()], made]
            size += m.start() - at + len(made)
            if size > most:
                return text
            at = end
        if not out:
            break
        text = "".join(out) + text[at:]
    return text


def inlined(files: dict[str, str], main: str, deepest: int = 8, seen: tuple[str, ...] = ()) -> str:
    """A file with its inputs in place, to a depth, each path at most once on a way down."""
    text = files.get(main, files.get(main + ".tex", ""))
    if deepest == 0 or main in seen:
        return "" if main in seen else text
    return re.sub(r"\\(?:input|include)\s*\{([^}]+)\}", lambda m: inlined(files, m[1].strip(), deepest - 1, (*seen, main)), text)


def main_file(files: dict[str, str]) -> str | None:
    """The file that looks most like a document's root, else the longest."""

    def score(name: str, text: str) -> tuple[int, int, str]:
        return 4 * ("\\documentclass" in text) + 3 * ("\\begin{document}" in text) + ("\\title" in text) + ("\\maketitle" in text) + ("main" in name.lower()), len(text), name

    tex = {n: t for n, t in files.items() if n.endswith(".tex")} or files
    return max(tex, key=lambda n: score(n, tex[n]), default=None)


def _cleaned(raw: pd.Series) -> pd.DataFrame:
    rows = [(*clean_sentence(x or ""), len(x or "")) for x in raw]
    return pd.DataFrame([(t, ok, r, n, len(t)) for t, ok, r, n in rows], columns=["text", "ok", "reasons", "raw_len", "clean_len"])


def _sentences(tex: pd.Series) -> pd.Series:
    return pd.Series([[{"sentence": s, "keys": k} for s, k in citing_sentences(x or "")] for x in tex])


def _intro(tex: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([intro_and_related(x or "") for x in tex], columns=["introduction", "related"])


def _bibliography(tex: pd.Series) -> pd.Series:
    return pd.Series([[{"cite_key": k, "fields": f} for k, f in bibitems(x or "") + bibtex_entries(x or "")] for x in tex])


#: Texts parsed at a time, and the fields of a bibliography entry that name a paper.
TEXTS, NAMING = 1_000, ("title", "eprint", "url", "journal", "booktitle", "note")


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS):
            b = whole.slice(at, TEXTS)
            of, ref, sentence, pos = [], [], [], []
            fields: dict[str, list] = {n: [] for n in NAMING}
            for i, text in enumerate(b.column(1).to_pylist()):
                entries = bibitems(text) + bibtex_entries(text) if text else []
                if not entries:
                    continue
                first: dict[str, tuple[int, str]] = {}
                for p, (s, keys) in enumerate(citing_sentences(text)):
                    for k in keys:
                        first.setdefault(k, (p, s))
                numbers: dict[str, int] = {}
                for key, found in entries:
                    of.append(i)
                    ref.append(numbers.setdefault(key, len(numbers)))
                    p, s = first.get(key, (None, None))
                    pos.append(p)
                    sentence.append(s)
                    for n, c in fields.items():
                        c.append(found.get(n))
            if of:
                columns = [b.column(0).take(pa.array(of)), pa.array(ref, pa.int32()), pa.array(sentence, pa.string()), pa.array(pos, pa.int64()), *(pa.array(c, pa.string()) for c in fields.values())]
                yield pa.RecordBatch.from_arrays(columns, ["paper_id", "ref", "sentence", "pos", *NAMING])


def references(papers: DataFrame) -> DataFrame:
    """papers (id, tex) to a row for each bibliography entry: paper_id, ref (a number for its key), the first sentence that cites the key with its place, if any does, and the fields that name a paper."""
    kind = papers.schema["id"].dataType.simpleString()
    return papers.select("id", "tex").mapInArrow(_references, f"paper_id {kind}, ref int, sentence string, pos bigint, {', '.join(f'{n} string' for n in NAMING)}")


# The wrappers are made when called, as their types need a session.
def cleaned(raw: str | Column) -> Column:
    """clean_sentence as struct<text, ok, reasons, raw_len, clean_len>."""
    return F.pandas_udf(_cleaned, "struct<text: string, ok: boolean, reasons: array<string>, raw_len: int, clean_len: int>")(raw)


def _expanded(tex: pd.Series) -> pd.Series:
    return pd.Series([expanded_macros(x or "") for x in tex])


def with_macros_expanded(tex: str | Column) -> Column:
    return F.pandas_udf(_expanded, "string")(tex)


def sentences_with_keys(tex: str | Column) -> Column:
    return F.pandas_udf(_sentences, "array<struct<sentence: string, keys: array<string>>>")(tex)


def introduction_and_related(tex: str | Column) -> Column:
    return F.pandas_udf(_intro, "struct<introduction: string, related: string>")(tex)


def bibliography(tex: str | Column) -> Column:
    return F.pandas_udf(_bibliography, "array<struct<cite_key: string, fields: map<string,string>>>")(tex)
