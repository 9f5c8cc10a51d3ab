from keysift.rules.dialect import JavaPattern, PatternError, translate
from keysift.rules.pack import (Allowlist, CompiledRule, Required, Rule, RulePack, builtin_pack,
                                load_pack, pack_from_dict, rejected_rules_frame, rules_frame)

__all__ = ["Allowlist", "CompiledRule", "JavaPattern", "PatternError", "Required", "Rule",
           "RulePack", "builtin_pack", "load_pack", "pack_from_dict", "rejected_rules_frame",
           "rules_frame", "translate"]
