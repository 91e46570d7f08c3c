"""Options of a search."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Bm25:
    """k1, the least idf, and b and weight of the fields command, description, keywords, tags."""

    k1: float = 1.2
    min_idf: float = 0.0
    b: tuple[float, float, float, float] = (0.75, 0.75, 0.70, 0.70)
    weight: tuple[float, float, float, float] = (3.5, 1.0, 2.0, 1.2)

    def overridden(self, k1: float | None = None, min_idf: float | None = None, b: tuple | None = None, weight: tuple | None = None) -> Bm25:
        """k1 if above 0, min_idf if not below 0, b (all four, clamped to 0..1), each weight if above 0."""
        return replace(
            self,
            k1=k1 if k1 is not None and k1 > 0 else self.k1,
            min_idf=min_idf if min_idf is not None and min_idf >= 0 else self.min_idf,
            b=tuple(min(1.0, max(0.0, x)) for x in b) if b else self.b,
            weight=tuple(new if new and new > 0 else old for new, old in zip(weight, self.weight)) if weight else self.weight,
        )


@dataclass(frozen=True)
class Options:
    limit: int = 10
    use_nlp: bool = True
    use_fuzzy: bool = False
    fuzzy_threshold: int = -30
    bigrams: bool = True
    char_grams: bool = True
    proximity: bool = True
    top_terms: int = 10
    platforms: tuple[str, ...] = ()
    current_platform: str = "linux"
    all_platforms: bool = False
    no_cross_platform: bool = False
    pipeline_only: bool = False
    pipeline_boost: float = 0.0
    context_boosts: dict[str, float] = field(default_factory=dict)
    bm25: Bm25 = Bm25()
    family_expansion: bool = False
    family_bases: int = 3
    family_clarity: float = 0.55
    family_blend: float = 0.25

    def normal(self) -> Options:
        """Q13: limits and family options that are not above 0 get their defaults."""
        return replace(
            self,
            limit=self.limit if self.limit > 0 else 10,
            family_clarity=self.family_clarity if self.family_clarity > 0 else 0.55,
            family_blend=self.family_blend if self.family_blend > 0 else 0.25,
            family_bases=self.family_bases if self.family_bases > 0 else 3,
            top_terms=self.top_terms if self.top_terms > 0 else 10,
        )
