"""Which external models are known to follow a release, and who may be asked."""

from __future__ import annotations

from dataclasses import dataclass

from dpspark.errors import ModelCapabilityError

VALIDATED, ADEQUATE, SWEEP_ONLY, INSUFFICIENT, UNKNOWN = "VALIDATED", "ADEQUATE", "SWEEP_ONLY", "INSUFFICIENT", "UNKNOWN"
BACKENDS = ("statistical", "callable")


@dataclass(frozen=True)
class Capability:
    tier: str
    usd_per_million_in: float = 0.0
    usd_per_million_out: float = 0.0


class ModelTable:
    """Models by the longest prefix of their name. It starts empty: what a model can do is for its user to measure."""

    def __init__(self) -> None:
        self._known: dict[str, Capability] = {}

    def register(self, prefix: str, tier: str, usd_in: float = 0.0, usd_out: float = 0.0) -> None:
        if tier not in (VALIDATED, ADEQUATE, SWEEP_ONLY, INSUFFICIENT):
            raise ValueError(f"no such tier: {tier}")
        self._known[prefix] = Capability(tier, usd_in, usd_out)

    def of(self, model: str) -> Capability:
        known = max((p for p in self._known if model.startswith(p)), key=len, default=None)
        return self._known[known] if known else Capability(UNKNOWN)

    def check(self, model: str, allow: tuple[str, ...] = (VALIDATED, ADEQUATE)) -> Capability:
        found = self.of(model)
        if found.tier not in allow:
            raise ModelCapabilityError(f"{model}: {found.tier}; allowed are {', '.join(allow)}")
        return found

    def validated(self) -> list[str]:
        return sorted(p for p, c in self._known.items() if c.tier == VALIDATED)

    def cost(self, model: str, tokens_in: int, tokens_out: int) -> float:
        c = self.of(model)
        return (tokens_in * c.usd_per_million_in + tokens_out * c.usd_per_million_out) / 1e6


class SpendMeter:
    """Adds up what calls cost and says when a budget is used up; what was made until then is kept."""

    def __init__(self, table: ModelTable, model: str, budget_usd: float | None = None):
        self.table, self.model, self.budget, self.usd = table, model, budget_usd, 0.0

    def add(self, tokens_in: int, tokens_out: int) -> bool:
        self.usd += self.table.cost(self.model, tokens_in, tokens_out)
        return self.affords(0.0)

    def affords(self, usd: float) -> bool:
        return self.budget is None or self.usd + usd < self.budget


def fits_context(prompt: str, output_tokens: int, context: int, chars_per_token: float = 3.5) -> bool:
    return len(prompt) / chars_per_token + output_tokens <= context
