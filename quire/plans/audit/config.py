"""Settings of the governance rules."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


def _cleaned(values: Iterable[str]) -> tuple[str, ...]:
    return tuple(v.strip() for v in values if v and v.strip())


@dataclass(frozen=True)
class GovernanceConfig:
    """Servers to accept besides the built-in ones, field-name labels to skip."""

    allowed_servers: tuple[str, ...] = ()
    disabled_pii_labels: tuple[str, ...] = ()

    def __init__(
        self, allowed_servers: Iterable[str] = (), disabled_pii_labels: Iterable[str] = ()
    ) -> None:
        object.__setattr__(self, "allowed_servers", _cleaned(allowed_servers))
        object.__setattr__(self, "disabled_pii_labels", _cleaned(disabled_pii_labels))
