"""User parameters of a clustering run (the `fit`/CLI surface)."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class ClusterParams:
    """All knobs of one run.

    ``semantics="reference"`` reproduces the behaviour of the original
    application including its quirks; ``"paper"`` switches every quirk to the
    reading of the DenStream paper.  Each quirk can also be set one by one.
    """

    num_dims: int = 2
    num_labels: int = 3
    lam: float = 0.25  # decay rate lambda, per time unit
    epsilon: float = 0.4  # online radius bound
    init_epsilon: float = 0.4  # neighbourhood radius of the initial DBSCAN
    mu: float = 10.0
    beta: float = 0.2
    tp: int = 4  # prune period, in non-empty batches
    offline_epsilon: float = 0.4
    offline_mu: float = 10.0
    batch_seconds: int = 5
    rate: int = 100  # expected rows per time unit
    semantics: str = "reference"
    # individual switches; None means "follow semantics"
    tag_seed: bool | None = None  # Q1
    paper_seeding: bool | None = None  # Q2
    radius_sum: bool | None = None  # Q4
    clamp_late: bool | None = None  # Q5
    accumulate_labels: bool | None = None  # Q6
    prune_fix: bool | None = None  # Q8
    macro_weight_once: bool | None = None  # Q9
    prune_period_from_tp: bool | None = None  # Q13
    # initialisation: "cells" (density clusters in no order, any size and
    # number of dimensions) or "scan" (the original's order; a component a
    # task, for small samples that must give the original's clusters)
    init_mode: str = "cells"
    # admission of unassigned points: "cells" (one aggregation, any size) or
    # "ordered" (the original's sequential rule, one task; small runs only)
    admit_mode: str = "cells"
    # the model's versions: of a state over this size a batch writes the changed
    # clusters only, and a whole state again after compact_every such batches
    log_over_bytes: int = 64 << 20
    compact_every: int = 20
    keep_versions: int = 3  # older versions that no kept one builds on are deleted
    # largest state (bytes of cf1+cf2) shipped to tasks as one broadcast
    max_broadcast_bytes: int = 64 << 20

    def _flag(self, value: bool | None) -> bool:
        return (self.semantics == "paper") if value is None else bool(value)

    @property
    def q_tag_seed(self) -> bool:
        return self._flag(self.tag_seed)

    @property
    def q_paper_seeding(self) -> bool:
        return self._flag(self.paper_seeding)

    @property
    def q_radius_sum(self) -> bool:
        return self._flag(self.radius_sum)

    @property
    def q_clamp_late(self) -> bool:
        return self._flag(self.clamp_late)

    @property
    def q_accumulate_labels(self) -> bool:
        return self._flag(self.accumulate_labels)

    @property
    def q_prune_fix(self) -> bool:
        return self._flag(self.prune_fix)

    @property
    def q_macro_weight_once(self) -> bool:
        return self._flag(self.macro_weight_once)

    @property
    def prune_every(self) -> int:
        return self.tp if self._flag(self.prune_period_from_tp) else 4

    @property
    def promote_weight(self) -> float:
        return self.beta * self.mu

    def with_(self, **kw) -> "ClusterParams":
        return replace(self, **kw)
