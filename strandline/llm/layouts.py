"""Conversation layouts, told apart by a fingerprint of their nested field paths, and how each becomes turns.

A layout is a declaration, not code: where the list of turns is (if there is
one) and which fields give role and text, or which fields are turns of which
role, one after another. Its fingerprint hashes the set of paths that it reads.
A record's own paths are first cut to those that some layout knows, so extra
fields change nothing; optional fields are part of a layout's variants.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache
from itertools import chain, combinations

#: Role names in the wild and what they mean here.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    name: str
    #: (role, path) for each turn that a field of its own holds; a second path is put behind the first with an empty line.
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    #: path of the list, and in its elements the fields of role and text.
    turns: tuple[str, str, str] | None = None
    #: paths that may be absent.
    optional: tuple[str, ...] = ()
    #: one record is one turn: fields of conversation, position, role and text.
    flat: tuple[str, str, str, str] | None = None

    def paths(self) -> set[str]:
        if self.flat:
            return set(self.flat)
        own = {p for _, ps in self.fields for p in ps}
        if self.turns:
            at, role, text = self.turns
            own |= {f"{at}[].{role}", f"{at}[].{text}"}
        return own


LAYOUTS = (
    Layout("turn rows", flat=("conv_id", "turn", "role", "text")),
    Layout("messages", fields=(("system", ("system",)),), turns=("messages", "role", "content"), optional=("system",)),
    Layout("messages of parts", fields=(("system", ("system",)),), turns=("messages", "role", "content[].text"), optional=("system",)),
    Layout("messages in data", turns=("data.messages", "role", "content")),
    Layout("conversations", fields=(("system", ("system",)),), turns=("conversations", "from", "value"), optional=("system",)),
    Layout("instruction", fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("prompt and response", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("prompt and completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question and answer", fields=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
)


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _variants(layout: Layout):
    for gone in chain.from_iterable(combinations(layout.optional, n) for n in range(len(layout.optional) + 1)):
        yield layout.paths() - set(gone)


#: Every layout's variants by fingerprint.
BY_FINGERPRINT = {fingerprint(v): layout for layout in reversed(LAYOUTS) for v in _variants(layout)}
KNOWN = frozenset(p for layout in LAYOUTS for p in layout.paths())


def paths_of(value, at: str = "") -> set[str]:
    """Nested field paths of a record; a list is marked ``[]`` and stands for all its elements."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths_of(v, f"{at}.{k}" if at else str(k))}
    if isinstance(value, list):
        return {p for v in value for p in paths_of(v, f"{at}[]")}
    return {at} if at else set()


@cache
def _layout_of(paths: frozenset[str]) -> Layout | None:
    return layout_of(paths)


def layout_of(paths: set[str] | frozenset[str]) -> Layout | None:
    """The layout for these paths. Fields that only other layouts know are dropped as far as needed, by the longest match."""
    known = paths & KNOWN
    if found := BY_FINGERPRINT.get(fingerprint(known)):
        return found
    fits = [(len(v), layout) for layout in LAYOUTS for v in _variants(layout) if v <= known]
    best = max((n for n, _ in fits), default=0)
    fits = [layout for n, layout in fits if n == best]
    return fits[0] if fits else None


def _get(value, path: str):
    for step in path.split("."):
        value = value.get(step) if isinstance(value, dict) else None
    return value


def written(value) -> str:
    """A field's value as text: null is empty, a number is as written; a list is its texts and those of its parts, with empty lines between, and what else stands there says nothing. Half of a surrogate pair, which is no character, becomes U+FFFD."""
    if isinstance(value, list):
        return "\n\n".join(t for x in value if (t := written(x.get("text") if isinstance(x, dict) else x)))
    if value is None or isinstance(value, dict):
        return ""
    text = value if isinstance(value, str) else str(value)
    try:
        text.encode()
    except UnicodeEncodeError:
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def canonical_role(role) -> str:
    role = written(role).strip().lower()
    return ROLES.get(role, role)


def turns_of(record: dict) -> list[tuple[str, str]] | None:
    """(role, text) of each turn of a record, by the layout of its own fingerprint; None where no layout fits. A record that is one turn keeps its role as it is."""
    layout = _layout_of(frozenset(paths_of(record)))
    if layout is None:
        return None
    if layout.flat:
        return [tuple(written(record.get(k)) for k in layout.flat[2:])]
    out = []
    for role, fields in layout.fields:
        said = [x for p in fields if (x := written(_get(record, p)))]
        if said or not set(fields) <= set(layout.optional):
            out.append((role, "\n\n".join(said)))
    if layout.turns:
        at, role, text = layout.turns
        listed = _get(record, at)
        out += [(canonical_role(t.get(role)), written(t.get(text.split("[]")[0]))) for t in (listed if isinstance(listed, list) else []) if isinstance(t, dict)]
    return out


def _listed(at: str, role: str, text: str, names: dict[str, str]):
    def lay(turns):
        value = [{role: names.get(r, r), text: t} for r, t in turns]
        for step in reversed(at.split(".")):
            value = {step: value}
        return value

    return lay


#: How the records of each source are laid out: a list of turns, or one question and its answer, with what is said before them.
LISTED = (_listed("messages", "role", "content", {}), _listed("conversations", "from", "value", {"user": "human", "assistant": "gpt"}), _listed("data.messages", "role", "content", {"user": "prompter"}))
PAIRED = (("prompt", "response", "system"), ("instruction", "output", "system"), ("question", "answer", None), ("prompt", "completion", None))


def laid_out(turns: list[tuple[str, str]], source: int):
    """Records of ``source`` (any whole number) that hold ``turns``; what its layout can't say as it is stands in a turn row."""
    lists = LISTED[source % len(LISTED)]
    paired = PAIRED[source // 2 % len(PAIRED)] if source % 2 else None
    i = 0
    while i < len(turns):
        if paired:
            ask, answer, before = paired
            k = i + (before is not None and turns[i][0] == "system" and turns[i][1] != "")
            if [r for r, _ in turns[k : k + 2]] == ["user", "assistant"]:
                yield ({before: turns[i][1]} if k > i else {}) | {ask: turns[k][1], answer: turns[k + 1][1]}
                i = k + 2
                continue
        j = i
        while j < len(turns) and canonical_role(turns[j][0]) == turns[j][0] and (j == i or not paired):
            j += 1
        if j > i:
            yield lists(turns[i:j])
        else:
            j = i + 1
            yield {"conv_id": source, "turn": i, "role": turns[i][0], "text": turns[i][1]}
        i = j
