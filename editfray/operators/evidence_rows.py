"""The greedy choice of a page's phrases, over its ranked rows. Counts of merged phrases are new; their score is the caller's, by the expression that all scores have."""

from __future__ import annotations

from ..functions.diff import overlap

FEW = 4


def _together(a, b) -> bool:
    """Whether two phrases were reverted by the same revisions, by and large."""
    x, y = set(a["revert_revision_ids"]), set(b["revert_revision_ids"])
    return len(x) >= FEW and len(y) >= FEW and len(x & y) >= 0.85 * len(x | y)


def _merged(group: list[dict]) -> dict:
    best = dict(group[0])
    if len(group) > 1:
        union = lambda c: set().union(*(set(r[c]) for r in group))
        best["changes"] = len(union("revision_ids")) or max(r["changes"] for r in group)
        best["reverts"] = len(union("revert_revision_ids")) or max(r["reverts"] for r in group)
        best["editors"] = len({u for u in union("editor_names") if u})
        best["changed_word_count"] = max(r["changed_word_count"] for r in group)
        for c in ("comment_count", "cleanup_comment_count"):
            best[c] = sum(r[c] for r in group)
        best["first_shot_comment"] = next((r["first_shot_comment"] for r in group if r["first_shot_comment"]), "")
    return best | {"group_size": len(group)}


def chosen(page: list[dict], limit: int) -> list[dict]:
    """page: its phrases in the order of their rank."""
    open_, out = page, []
    while open_ and len(out) < limit:
        head, *open_ = open_
        clashes = lambda r: any(overlap(r["segment"], x["segment"]) for x in out)
        if clashes(head):
            continue
        open_ = [r for r in open_ if not clashes(r)]
        group = [head] + [r for r in open_ if _together(head, r)]
        open_ = [r for r in open_ if not _together(head, r)]
        out.append(_merged(group) | {"place": len(out) + 1})
    return out
