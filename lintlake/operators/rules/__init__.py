from lintlake.operators.rules.rule import CallTest, Rule
from lintlake.operators.rules.rulebook import RULEBOOK, rules_for

__all__ = ["CallTest", "Rule", "RULEBOOK", "rules_for"]
