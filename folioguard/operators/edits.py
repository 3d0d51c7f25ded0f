"""Page edits of scan sessions, and review toggles: ordered logs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .fold import fold

UNDO_MS = 5000


def edit(state: dict, row: dict) -> dict:
    """One edit of a session's pages.

    ``add`` appends ``page``; ``move`` swaps the page at ``index`` with the one
    ``direction`` away; ``remove`` takes ``page`` out; ``replace`` puts ``payload``
    in its place; ``undo`` puts the page that was removed last back at
    ``min(old index, length)``, if that is at most five seconds ago and it is not
    there.  What is out of range or unknown changes nothing.
    """
    pages, op, i = state["pages"], row["op"], row["index"]
    if op == "add":
        pages.append(row["page"])
    elif op == "move" and i is not None and row["direction"] in (-1, 1):
        j = i + row["direction"]
        if 0 <= i < len(pages) and 0 <= j < len(pages):
            pages[i], pages[j] = pages[j], pages[i]
    elif op == "remove" and row["page"] in pages:
        at = pages.index(row["page"])
        state["gone"] = (row["page"], at, row["ms"])
        state["pages"] = [p for p in pages if p != row["page"]]
    elif op == "replace":
        state["pages"] = [row["payload"] if p == row["page"] else p for p in pages]
    elif op == "undo" and state["gone"]:
        page, at, ms = state["gone"]
        state["gone"] = None
        if row["ms"] - ms <= UNDO_MS and page not in pages:
            pages.insert(min(at, len(pages)), page)
    return state


def page_edits(log: DataFrame) -> DataFrame:
    """(``session_id``, ``pages``) after all edits (``session_id``, ``seq``,
    ``op``, ``page``, ``index``, ``direction``, ``payload``, ``ms``)."""
    return fold(log, "session_id", ["seq"], lambda: {"pages": [], "gone": None}, edit, lambda k, s: {"session_id": k, "pages": s["pages"]}, "session_id string, pages array<string>")


def toggle(selected: dict, row: dict) -> dict:
    """One review click: ``ids`` with one id flips it; with several, all become
    selected unless all were.  A row with ``start`` tells a detection's first
    state."""
    if row["start"] is not None:
        selected[row["ids"][0]] = row["start"]
        return selected
    known = [i for i in row["ids"] if i in selected]
    if known:
        value = not all(selected[i] for i in known)
        selected.update(dict.fromkeys(known, value))
    return selected


def review_clicks(log: DataFrame) -> DataFrame:
    """(``doc_id``, ``selected``) after all clicks (``doc_id``, ``seq``, ``ids``,
    ``start``); ``selected`` is an array of the selected ids, sorted."""
    return fold(log, "doc_id", ["seq"], dict, toggle, lambda k, s: {"doc_id": k, "selected": sorted(i for i, on in s.items() if on)}, "doc_id long, selected array<string>")
