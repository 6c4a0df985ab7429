"""The analysis of a collection: from documents to planned families and invariants."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CANDIDATE_THRESHOLD, CONTEXT_LIMIT, SAFETY_RATIO
from ..operators import invariants as I
from ..operators import ledger, relate
from ..sources.scratch import stored
from . import planner


class Analysis:
    """Tables of one run, all keyed by doc_id. Each is worked out when it is first asked for, so a reader of units pays
    for no pairs; sections, units, edges, members, families, family units, pairs, choice, decisions and plan are each read
    by several later tables and go through keep, the rest stays lazy."""

    def __init__(self, documents: DataFrame, rejects: DataFrame, *, context_limit: int, safety_ratio: float, candidate_threshold: float, keep) -> None:
        self.documents, self.rejects = documents, rejects
        self._context_limit, self._safety_ratio, self._threshold, self._keep = context_limit, safety_ratio, candidate_threshold, keep

    @cached_property
    def bare_units(self) -> DataFrame:
        return self._keep(ledger.bare_units(self.documents))

    @cached_property
    def units(self) -> DataFrame:
        return ledger.with_words(self.bare_units)

    @cached_property
    def sections(self) -> DataFrame:
        return self._keep(ledger.sections(self.documents).drop("body"))

    @cached_property
    def edges(self) -> DataFrame:
        return self._keep(relate.candidate_edges(self.units, self._threshold))

    @cached_property
    def members(self) -> DataFrame:
        return self._keep(relate.family_members(self.edges))

    @cached_property
    def families(self) -> DataFrame:
        return self._keep(relate.families(self.units, self.members))

    @cached_property
    def family_units(self) -> DataFrame:
        return self._keep(relate.family_units(self.units, self.members, self.families))

    @cached_property
    def pairs(self) -> DataFrame:
        return self._keep(relate.family_pairs(self.family_units, self.edges))

    @cached_property
    def scores(self) -> DataFrame:
        return planner.centre_scores(self.family_units, self.families)

    @cached_property
    def choice(self) -> DataFrame:
        return self._keep(planner.centre_choice(self.scores))

    @cached_property
    def decisions(self) -> DataFrame:
        return self._keep(planner.decisions(self.family_units, self.pairs, self.choice))

    @cached_property
    def plan(self) -> DataFrame:
        counts = self.sections.groupBy("doc_id").agg(F.count("*").alias("n_sections")).join(self.units.groupBy("doc_id").agg(F.count("*").alias("n_units")), "doc_id").hint("merge")
        return self._keep(planner.plan(self.families, self.decisions, self.choice, counts))

    @cached_property
    def resource_plan(self) -> DataFrame:
        return ledger.resource_plan(self.documents, self.sections, context_limit=self._context_limit, safety_ratio=self._safety_ratio)

    def with_only(self, *names: str) -> Analysis:
        """The same analysis with no more than the tables named of those worked out; the others are worked out anew if asked
        for, so their files may go."""
        out = Analysis(self.documents, self.rejects, context_limit=self._context_limit, safety_ratio=self._safety_ratio, candidate_threshold=self._threshold, keep=self._keep)
        out.__dict__.update({n: getattr(self, n) for n in names})
        return out

    @property
    def invariants(self) -> DataFrame:
        return I.invariants(self.documents, self.units, self.plan, self.decisions)

    @property
    def complexity(self) -> DataFrame:
        return I.complexity(self.documents, self.resource_plan, self.sections, self.units, self.plan)


def analyse(docs: DataFrame, *, context_limit: int = CONTEXT_LIMIT, safety_ratio: float = SAFETY_RATIO, candidate_threshold: float = CANDIDATE_THRESHOLD, keep=stored, admitted: bool = False) -> Analysis:
    """Analyse ``doc_id, text``.

    keep: what to do with tables that several later ones read; by default they are written once to the shared folder.
    admitted: docs have been through ``ledger.admit``.
    """
    if context_limit < 1000:
        raise ValueError("the configured context limit is implausibly small")
    good, bad = (docs.select("doc_id", "text"), docs.select("doc_id", F.lit("").alias("reason")).limit(0)) if admitted else ledger.admit(docs)
    return Analysis(good, bad, context_limit=context_limit, safety_ratio=safety_ratio, candidate_threshold=candidate_threshold, keep=keep)
