"""Rule packs over the whole estate, one findings table out."""

from quire.plans.audit.config import GovernanceConfig
from quire.plans.audit.registry import Hit, Registry, Rule, RuleMeta, default_registry

__all__ = ["GovernanceConfig", "Hit", "Registry", "Rule", "RuleMeta", "default_registry"]
