"""All rounds of a document's safe pass in plain Python.

A round of ``safe_pass.safe_pass`` analyses every open document from its text anew, in some forty tables. A document's
rounds read nothing of other documents, so where only their outcome is asked for they run here, one document in memory at
a time. What a sentence says and how it compares with others follows from its text alone and is worked out once a
document, whatever the number of rounds. The rules are those of ``ledger``, ``relate``, ``planner`` and ``transact``; a
test holds the two together.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np

from ..config import CANDIDATE_THRESHOLD, CENTRE_FIT, CONCEPT_GROUPS, EVIDENCE_TITLES, MAX_TRANSACTIONS, PROTECTED, ROLE_MARKERS, STOPWORDS, TITLE_RULES
from ..operators.relate import WITHOUT_CONCEPT, _cliques

HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$", re.M)
PARAGRAPH = re.compile(r"\s*\n\s*\n\s*")
SENTENCE = re.compile(r"""(?<=[.!?])\s+(?=[A-Z0-9"'])""")
NUMBER = re.compile(r"(?<!\w)(?:[$€£]?\d[\d,.]*(?:%|\s*(?:[Uu][Ss][Dd]|[Ee][Uu][Rr]|[Gg][Bb][Pp]))?)(?!\w)")
QUOTATION = re.compile(r'[“"]([^”"]{2,})[”"]')
CITATION = re.compile(r"(?:\[[^\]]+\]|\([^)]*(?<!\w)(?:19|20)\d{2}[^)]*\))")
TERM = re.compile(r"(?<!\w)[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){1,4}(?!\w)")
_ODD = re.compile(r"[^\w\s%$€£-]")

_STOP = frozenset(STOPWORDS)
_CONCEPT = {word: f"c{i}" for i, group in enumerate(CONCEPT_GROUPS) for word in group.split()}
_SHOWN = {f"c{i}": min(group.split()) for i, group in enumerate(CONCEPT_GROUPS)}
#: Meetings with earlier sentences, from which on they are counted in arrays.
_MANY = 256


def normalise(text: str) -> str:
    return " ".join(_ODD.sub(" ", text.lower()).split())


def _role(text: str) -> str:
    low = text.lower()
    for role, words in ROLE_MARKERS:
        for word in words:
            if word in low:
                return role
    return "claim"


def _function(title: str, role: str) -> str:
    low = title.lower()
    for name, words in TITLE_RULES:
        if any(word in low for word in words):
            return name
    if role == "evidence" or any(word in low for word in EVIDENCE_TITLES):
        return "evidentiary"
    return "definitory" if role == "definition" else "context"


class Sentence:
    """What follows from a sentence's text alone; what only recurring sentences need is worked out when asked for."""

    def __init__(self, text: str) -> None:
        self.text, self.normal = text, normalise(text)
        words = set(self.normal.split())
        self.mass = len(words)
        self.content = {w for w in words - _STOP if len(w) > 2}
        self.plain = _CONCEPT.keys().isdisjoint(self.content)
        self.concepts = self.content if self.plain else {_CONCEPT.get(w, w) for w in self.content}

    @cached_property
    def role(self) -> str:
        return _role(self.text)

    @cached_property
    def hard(self) -> set[str]:
        return {*NUMBER.findall(self.text), *CITATION.findall(self.text), *TERM.findall(self.text)}

    @cached_property
    def anchors(self) -> set[str]:
        return self.hard | set(QUOTATION.findall(self.text))


class Unit:
    """An occurrence of a sentence: its place in the text, and its section, paragraph and number there."""

    def __init__(self, kind: int, own: Sentence, order: int, start: int, title: str, lead: tuple[str, int, int]) -> None:
        self.kind, self.own, self.ord, self.start, self.end = kind, own, order, start, start + len(own.text)
        self.title, self.lead, self.function = title, lead, _function(title, own.role)

    @cached_property
    def unit_id(self) -> str:
        return "u_" + hashlib.sha256("|".join((*map(str, self.lead), self.own.normal)).encode()).hexdigest()[:12]


def _cut(text: str, pattern: re.Pattern) -> Iterator[tuple[int, re.Match | None, str]]:
    """(place, match before, piece) of the pieces between matches of pattern."""
    at, before = 0, None
    for found in pattern.finditer(text):
        yield at, before, text[at : found.start()]
        at, before = found.end(), found
    yield at, before, text[at:]


def sections(text: str) -> list[tuple[str, str, int, str]]:
    """(id, title, place, body) of a text's sections."""
    cut = list(_cut(text, HEADING))
    if len(cut) == 1:
        return [("s_001", "Document", 0, text)]
    return [(f"s_{k:03d}", found.group(2).strip() if found else "Preamble", at, body) for k, (at, found, body) in enumerate(cut) if k or body.strip()]


def sentences(body: str, start: int) -> Iterator[tuple[int, int, int, str]]:
    """(paragraph, sentence, place, text) of a section's sentences."""
    paragraphs = ((at, piece) for at, _, piece in _cut(body, PARAGRAPH) if piece.strip())
    for p, (at, piece) in enumerate(paragraphs):
        own = ((place, raw, text) for place, _, raw in _cut(piece, SENTENCE) if (text := raw.strip()))
        for s, (place, raw, text) in enumerate(own):
            yield p, s, start + at + place + len(raw) - len(raw.lstrip()), text


def _overlap(shared: int, a: int, b: int) -> float:
    return 0.0 if not a or not b else max(shared / (a + b - shared), 0.75 * (shared / min(a, b)))


class Kinds:
    """The distinct sentences that a document has had, and which pairs of them reach the threshold.

    A new one is compared with those before it, met by the concepts they share; ``near`` has the rounded composites.
    Without a shared concept, and a threshold above what anchors and roles can give, there is no pair.
    """

    def __init__(self, threshold: float = CANDIDATE_THRESHOLD) -> None:
        if threshold <= WITHOUT_CONCEPT:
            raise ValueError("the threshold must be above what anchors and roles can give")
        self.threshold, self.number, self.own, self.near = threshold, {}, [], []
        # where words and concepts are the same, a pair shares this part of the smaller side's at least; the margin is for rounding
        self._least = (threshold - 0.0002 - WITHOUT_CONCEPT) / 0.7
        self._holders: dict[str, array] = {}
        self._sizes = array("i")  # numbers of concepts; 0 for sentences whose words and concepts differ

    def __call__(self, text: str) -> int:
        k = self.number.get(text)
        if k is None:
            k = self.number[text] = len(self.own)
            self._meet(k, Sentence(text))
        return k

    def recurs(self, k: int) -> None:
        """Sentence k occurs again in a text, so it is a pair with itself."""
        if k not in self.near[k] and self.own[k].concepts:
            self._score(k, k, len(self.own[k].concepts))

    def _meet(self, k: int, new: Sentence) -> None:
        self.own.append(new)
        self.near.append({})
        if new.concepts:
            met = [self._holders[w] for w in new.concepts if w in self._holders]
            if met:
                for i, shared in self._found(met, k, len(new.concepts) if new.plain else 0):
                    self._score(k, i, shared)
            for w in new.concepts:
                if w in self._holders:
                    self._holders[w].append(k)
                else:
                    self._holders[w] = array("i", (k,))
        self._sizes.append(len(new.concepts) if new.plain else 0)

    def _found(self, met: list[array], k: int, size: int) -> list[tuple[int, int]]:
        """(earlier sentence, number of shared concepts) where these are enough."""
        least, sizes = self._least, self._sizes
        if sum(map(len, met)) < _MANY:
            return [(i, n) for i, n in Counter(chain.from_iterable(met)).items() if n >= least * min(size, sizes[i])]
        # arrays are copied, for they can't grow while something else looks at them
        counts = np.bincount(np.concatenate([np.array(own, np.int32) for own in met]), minlength=k)
        some = np.flatnonzero(counts)
        some = some[counts[some] >= least * np.minimum(size, np.array(sizes, np.int32)[some])]
        return list(zip(some.tolist(), counts[some].tolist()))

    def _score(self, a: int, b: int, con: int) -> None:
        x, y = self.own[a], self.own[b]
        raw = con if x.plain or y.plain else len(x.content & y.content)  # a word of a group is none of a plain sentence's
        lex, theme = _overlap(raw, len(x.content), len(y.content)), _overlap(con, len(x.concepts), len(y.concepts))
        if 0.35 * lex + 0.35 * theme + WITHOUT_CONCEPT < self.threshold - 0.0001:
            return  # whatever anchors and roles give
        rol = 1.0 if x.role == y.role else 0.35
        anchors = len(x.hard) + len(y.hard)
        hard = len(x.hard & y.hard)
        anc = hard / (anchors - hard) if anchors else 0.5
        composite = round(0.35 * lex + 0.35 * theme + 0.15 * anc + 0.15 * rol, 4)
        if composite >= self.threshold:
            self.near[a][b] = self.near[b][a] = composite


class Family:
    """The members of a family in order, with what the plan decides for them."""

    def __init__(self, members: list[Unit], near: list[dict[int, float]], n_sections: int, n_units: int) -> None:
        self.members = members
        n = len(members)
        means = []
        for u in members:
            total, own = 0.0, near[u.kind]
            for v in members:
                if v is not u:
                    total += own[v.kind]
            means.append(total / (n - 1))
        self.sections = {u.title for u in members}
        self.centre = self._centre()
        words, twins = Counter(w for u in members for w in u.own.content), Counter(u.own.normal for u in members)
        self.residual = [sum(words[w] == 1 for w in u.own.content) for u in members]
        self.relation = [self._relation(mean, twins[u.own.normal], left) for u, mean, left in zip(members, means, self.residual)]
        self.disposition = [self._disposition(u, relation) for u, relation in zip(members, self.relation)]
        partial, review = self.relation.count("partial_overlap"), self.disposition.count("human_review")
        self.risk = round(0.3 * (partial / n) + 0.25 * (len(self.sections) / max(1, n_sections)) + 0.25 * (review / n) + 0.2 * min(1.0, n / max(2, n_units)), 4)

    def _centre(self) -> str:
        by: dict[str, list[Unit]] = {}
        for u in self.members:
            by.setdefault(u.title, []).append(u)

        def score(own: list[Unit]) -> float:
            fit, mass = max(CENTRE_FIT[u.function] for u in own), sum(u.own.mass for u in own)
            evidence = any(u.function == "evidentiary" for u in own)
            return round(
                0.35 * fit + 0.25 * min(1.0, mass / 45.0) + 0.15 * (1.0 if evidence else 0.45) + 0.15 * (1.0 if len(own) > 1 else 0.65) + 0.1 * (1.0 / (1 + max(0, len(by) - 1))), 4
            )

        return min(by, key=lambda title: (-score(by[title]), by[title][0].ord))

    @staticmethod
    def _relation(mean: float, twins: int, residual: int) -> str:
        if mean >= 0.92:
            return "exact_equivalent"
        if mean >= 0.68:
            return "partial_overlap" if twins == 1 and residual >= 3 else "paraphrase_equivalent"
        return "partial_overlap" if mean >= 0.50 else "uncertain" if mean >= 0.43 else "related_non_duplicate"

    def _disposition(self, u: Unit, relation: str) -> str:
        if u.function in PROTECTED:
            return "preserve_in_place"
        if relation in ("uncertain", "related_non_duplicate"):
            return "human_review"
        if u.title == self.centre or u.function in ("summary", "conclusive"):
            return "preserve_in_place"
        return "human_review" if relation == "partial_overlap" else "merge_into_centre"

    def donors(self) -> tuple[list[Unit], bool]:
        """(donors whose anchors the receiver has, whether others were left alone)."""
        kept = [u for u, how in zip(self.members, self.disposition) if u.title == self.centre and how == "preserve_in_place"]
        if not kept:
            return [], False
        receiver = max(kept, key=lambda u: (u.own.mass, -u.start, -u.ord)).own
        same = [
            u for u, relation, how, left in zip(self.members, self.relation, self.disposition, self.residual)
            if how == "merge_into_centre" and relation == "exact_equivalent" and not left and u.own.normal == receiver.normal
        ]
        safe = [u for u in same if u.own.anchors <= receiver.anchors]
        return safe, len(safe) < len(same)

    def label(self) -> str:
        vocabulary = set().union(*(u.own.content for u in self.members))
        common = set.intersection(*(set(u.own.concepts) for u in self.members))
        root = lambda *roots: any(w.startswith(roots) for w in vocabulary)
        if root("access") and root("review"):
            return "Periodic access-control review"
        if "source" in vocabulary and root("transform"):
            return "Transformation provenance record"
        if (root("evidence", "proof", "record") or "c2" in common) and root("repeat", "restat", "explan", "consolid"):
            return "Evidence-preserving consolidation"
        useful = [w for w in sorted({_SHOWN.get(c, c) for c in common if c != "every"}) if len(w) > 2]
        if not useful:
            return "Recurring semantic theme"
        shown = " · ".join(useful[:3]).replace("_", " ")
        return "".join(c.lower() if before.isalpha() else c.upper() for before, c in zip(" " + shown, shown))


def _edges(places: dict[int, list[int]], near: list[dict[int, float]]) -> Iterator[tuple[int, int]]:
    for kind, at in places.items():
        for other in near[kind]:
            if other > kind and other in places:
                yield from ((a, b) for a in at for b in places[other])
            elif other == kind:
                yield from ((a, b) for i, a in enumerate(at) for b in at[i + 1 :])


def _families(text: str, kinds: Kinds) -> list[Family]:
    """The families of a text in the order of its plan."""
    found, rows, places = sections(text), [], {}
    for section in found:
        for p, s, at, sentence in sentences(section[3], section[2]):
            kind = kinds(sentence)
            if kind in places:
                kinds.recurs(kind)
                places[kind].append(len(rows))
            else:
                places[kind] = [len(rows)]
            rows.append((kind, at, section, p, s))

    def unit(i: int) -> Unit:
        kind, at, (ident, title, *_), p, s = rows[i]
        return Unit(kind, kinds.own[kind], i, at, title, (ident, p, s))

    groups = (Family([unit(i) for i in group], kinds.near, len(found), len(rows)) for group in _cliques(_edges(places, kinds.near)))
    return [f for _, _, _, f in sorted((f.risk, len(f.members), k, f) for k, f in enumerate(groups))]


def revise(text: str, max_transactions: int = MAX_TRANSACTIONS) -> tuple[str, int, bool]:
    """(revised text, eligible families that remain, whether the cap of transactions stopped the pass)."""
    kinds, tried = Kinds(), set()
    for _ in range(max_transactions):
        families = _families(text, kinds)
        ready = [f.donors() for f in families]
        chosen = None
        for f, (donors, unsafe) in zip(families, ready):
            ids = sorted(u.unit_id for u in f.members)
            signature = "|".join(ids)
            if signature in tried:
                continue
            tried.add(signature)
            if donors and not unsafe and len(set(ids)) == len(ids):
                repair = f"See {f.centre} for the canonical treatment of {f.label()}."
                if donors[0].own.normal not in normalise(repair):  # all have the receiver's normalised text
                    chosen = donors
                    break
        if chosen is None:
            return text, sum(bool(donors) for donors, _ in ready), False
        pieces, at = [], 0
        for u in chosen:
            pieces += [text[at : u.start], repair]
            at = u.end
        text = "".join(pieces) + text[at:]
    return text, 0, True
