"""Greedy selections, whose steps depend on those before: one Arrow group per query."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"[a-z0-9]+")


def _set(text: str | None) -> frozenset[str]:
    return frozenset(x for x in _TOKEN.findall((text or "").lower()) if len(x) > 2)


def _jaccard(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def chosen_titles(titles: Iterable[str | None], most: int, long_enough: int = 24) -> list[int]:
    """Places of the first `most` titles that neither equal nor contain, nor are held by, one chosen before."""
    chosen: list[str] = []
    exact: set[str] = set()
    out: list[int] = []
    for i, title in enumerate(titles):
        t = " ".join((title or "").lower().split())
        if not t or t in exact or any(min(len(t), len(c)) >= long_enough and (t in c or c in t) for c in chosen):
            continue
        exact.add(t)
        chosen.append(t)
        out.append(i)
        if len(out) == most:
            break
    return out


def suppressed_titles(items: DataFrame, most: int, long_enough: int = 24) -> DataFrame:
    """(qid, cid, ord): items whose title neither equals nor contains, nor is held by, one chosen before.

    items: qid, cid, ord, title. A group is a query's candidate list.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(["ord", "cid"])
        kept = d.iloc[chosen_titles(d["title"], most, long_enough)]
        return pd.DataFrame({"qid": kept["qid"], "cid": kept["cid"], "ord": range(1, len(kept) + 1)})

    types = dict(items.dtypes)
    return items.select("qid", "cid", "ord", "title").groupBy("qid").applyInPandas(pick, f"qid {types['qid']}, cid {types['cid']}, ord bigint")


def diverse(items: DataFrame, most: int, similar: float = 0.8, template: str = "this work is related to") -> DataFrame:
    """(qid, ord, text): texts in order that are no near-copies of chosen ones; templates last and one at most."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.ord, r.text or "", _set(r.text)) for r in pdf.sort_values(["ord", "text"]).itertuples() if (r.text or "").strip()]
        plain = [r for r in rows if not r[1].lower().startswith(template)]
        stock = [r for r in rows if r[1].lower().startswith(template)]
        out: list[tuple] = []
        for part, limit in ((plain, most), (stock, 1)):
            taken = 0
            for o, t, s in part:
                if len(out) < most and taken < limit and all(_jaccard(s, c) < similar for _, _, c in out):
                    out.append((o, t, s))
                    taken += 1
        return pd.DataFrame([(pdf["qid"].iloc[0], o, t) for o, t, _ in out], columns=["qid", "ord", "text"])

    types = dict(items.dtypes)
    return items.select("qid", "ord", "text").groupBy("qid").applyInPandas(pick, f"qid {types['qid']}, ord {types['ord']}, text string")


def aligned_predictions(predicted: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, ord, cid): predictions matched to candidates by id, else equal title, else the longest containment; a candidate matches once.

    predicted: qid, ord, id, title; candidates: qid, cid, title.
    """

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        flat = lambda t: " ".join(str(t or "").lower().split())
        right = right.sort_values("cid")  # of equal titles the least id is first
        free = {str(c): flat(t) for c, t in zip(right["cid"], right["title"], strict=True)}
        own = {str(c): c for c in right["cid"]}
        out = []
        for r in left.sort_values("ord").itertuples():
            t, hit = flat(r.title), None
            if r.id is not None and str(r.id) in free:
                hit = str(r.id)
            elif t:
                hit = next((c for c, x in free.items() if x == t), None)
                if hit is None:
                    hit = max((c for c, x in free.items() if x and (x in t or t in x)), key=lambda c: (len(free[c]), c), default=None)
            if hit is not None:
                free.pop(hit)
                out.append((r.qid, r.ord, own[hit]))
        return pd.DataFrame(out, columns=["qid", "ord", "cid"])

    types = {**dict(predicted.dtypes), **dict(candidates.dtypes)}
    return predicted.groupBy("qid").cogroup(candidates.groupBy("qid")).applyInPandas(match, f"qid {types['qid']}, ord {types['ord']}, cid {types['cid']}")
