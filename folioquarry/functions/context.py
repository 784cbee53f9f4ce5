"""Bounded contexts and samples of texts."""

from __future__ import annotations

# What stands before and after the passages.
HEAD = "# REFERENCE CONTEXT\nUse these passages to resolve references and keep the wording consistent. They are not to be translated."
TAIL = "\n\n# END REFERENCE CONTEXT"
OMITTED = "\n\n[… omitted …]\n\n"


def fair_shares(lengths: list[int], budget: int) -> list[int]:
    """How much of each length a budget can grant: equal shares, and what short ones leave goes to the longer ones."""
    out = [0] * len(lengths)
    for place, k in enumerate(sorted(range(len(lengths)), key=lengths.__getitem__)):
        out[k] = min(lengths[k], budget // (len(lengths) - place))
        budget -= out[k]
    return out


def shortened(text: str, limit: int, tail: bool = False) -> str:
    """At most ``limit`` characters, with an ellipsis where the rest was; with ``tail`` the end is kept."""
    if len(text) <= limit:
        return text
    return "…"[:limit] if limit <= 1 else "…" + text[1 - limit :] if tail else text[: limit - 1] + "…"


def neighbour_context(ordinal: int, heading: str | None, neighbours: list[tuple[int, str, str]], most: int, translations: bool) -> str:
    """Passages around a segment under one budget of characters; ``neighbours``: (ordinal, source, translation). '' if the budget holds nothing.

    Passages before are cut at their beginning, those after at their end, so that what is nearest stays.
    """
    parts = [("# LOCATION", heading, False)] if heading else []
    for at, source, rendering in sorted(neighbours):
        if at != ordinal:
            side, before = ("PREVIOUS", True) if at < ordinal else ("FOLLOWING", False)
            parts.append((f"# {side} SOURCE (segment {at})", source, before))
            if translations and rendering:
                parts.append((f"# {side} TRANSLATION (segment {at})", rendering, before))
    room = most - len(HEAD) - len(TAIL) - sum(len(t) + 3 for t, _, _ in parts)
    if not parts or room < len(parts):
        return ""
    shares = fair_shares([len(v) for _, v, _ in parts], room)
    return "\n\n".join([HEAD, *(f"{t}\n{shortened(v, n, before)}" for (t, v, before), n in zip(parts, shares))]) + TAIL


def snapped(text: str, at: int, forward: bool, reach: int = 60) -> int:
    """The place next to the first white space within ``reach`` characters of ``at``, else ``at``."""
    if forward:
        return 0 if at <= 0 else next((k + 1 for k in range(at, min(len(text), at + reach)) if text[k].isspace()), at)
    return len(text) if at >= len(text) else next((k - 1 for k in range(at, max(0, at - reach), -1) if text[k - 1].isspace()), at)


def sample(text: str, budget: int, excerpts: int = 8, least: int = 200) -> tuple[str, int]:
    """(excerpts joined, their number) spread evenly over a text within a budget of characters; the whole text if it fits."""
    if budget <= 0 or not text:
        return "", 0
    if len(text) <= budget:
        return text, 1
    count = min(max(1, excerpts), max(1, budget // max(1, least)))
    if count == 1:
        return text[:budget], 1
    window = max(1, max(count, budget - len(OMITTED) * (count - 1)) // count)
    parts, done = [], 0
    for k in range(count):
        a = max(snapped(text, round(k * max(0, len(text) - window) / (count - 1)), True), done)
        b = snapped(text, min(len(text), a + window), False)
        b = b if b > a else min(len(text), a + window)
        if piece := text[a:b].strip():
            parts.append(piece)
            done = b
    return OMITTED.join(parts)[:budget], len(parts)
