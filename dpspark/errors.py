"""Refusals: what the engine will not do, told without any private value."""

from __future__ import annotations


class Refusal(Exception):
    """A request that is turned down; every other exception is a fault."""


class AccountingError(Refusal):
    """More privacy budget is asked for than there is, or a ledger is closed."""


class SchemaError(Refusal):
    """A public schema contradicts itself."""


class DataValidationError(Refusal):
    """A table does not fit its public schema."""


class ReleaseError(Refusal):
    """A release can't be made as asked."""


class GenerationError(Refusal):
    """Rows can't be generated from a release as asked. paid: tables of the rows that were made until then."""

    paid: list[str] = []


class ContextTruncationError(GenerationError):
    """A request is longer than the model's context."""


class EmptyContentError(GenerationError):
    """A model returned nothing."""


class ModelRefusalError(GenerationError):
    """A model declined; asking again does not help."""


class FatalAPIError(GenerationError):
    """A model's service turned the request down for good."""


class RateLimitedError(Refusal):
    """A model's service asks to wait."""


class ModelCapabilityError(Refusal):
    """A model is not known to follow a release."""


class BoundError(Refusal):
    """A transmission bound can't be computed as asked."""


class PromptIntegrityError(Refusal):
    """A prompt template is not what was registered."""


class CorrectionError(Refusal):
    """A table can't be corrected as asked."""


class DomainTooLargeError(CorrectionError):
    """A public domain is too large for the method."""
