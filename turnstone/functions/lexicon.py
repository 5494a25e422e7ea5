"""Words and patterns that tell decisions from other talk.

They must be as they are for decisions to come out the same. All are matched on text
in lower case (A-Z only), patterns on the text itself.
"""

from __future__ import annotations

# Patterns of intent. Those of the second table mind the case.
INTENT = {
    "request_leadin": r"\b(?:can|could|would|will)\s+you\b|\bplease\b|\bpls\b|\blet'?s\b|\blet us\b|\bgo ahead\b|\bi\s*(?:'?d like|want|need)\s+you\s+to\b|\bhow about you\b|\bcould we\b|\bwhy don'?t we\b",
    "imperative_start": r"^\s*(?:add|create|implement|build|write|generate|scaffold|stub|fix|change|update|modify|adjust|tweak|patch|correct|resolve|refactor|rename|extract|inline|remove|delete|drop|strip|prune|use|using|adopt|switch|migrate|standardi[sz]e|optimi[sz]e|improve|harden|saniti[sz]e|ensure|make|set|bump|upgrade|downgrade|test|run|help|investigate|check|review|keep|move|split|merge|consolidate|clean|wire|hook|install|enable|disable|swap|replace|substitute|handle|support|skip|deprecate|retire|imagine|spin|let'?s|please|just\s+make)\b",
    "subordinate_lead": r"^\s*(?:but|since|so|and|or|because|although|though|while|whereas|if|when|then)\b",
    "first_person": r"\b(?:i|i'?m|i'?ve|i'?ll|i'?d|we|we'?re|we'?ve|we'?ll|us|our|my|me|let'?s)\b",
    "second_person": r"\b(?:you|you'?re|you'?ve|you'?ll|your|yourself)\b",
    "third_person_lead": r"^\s*(?:the|this|that|it|its|they|their|these|those|both|each|all|every|a|an)\b",
    "code_lead": r"^\s*(?:rs|ts|tsx|js|jsx|py|go|rb|kt|swift|yml|yaml|toml|json|md|vscdb|gl|fts|sql|ann|hnsw)\b",
    "code_describe": r"^\s*(?:the\s+[a-z]+|it|this|that|these|those|[A-Z][a-zA-Z]{2,})\s+(?:\w+\s+){0,3}?(?:hand|recreate|enumerate|cap|caps|disable|enable|return|render|implement|store|fetch|wrap|hold|emit|yield|reassign|process|allocate|freeze|re-?measure|fall\s+back)s?\b",
    "doc_intro": r"(?:^|\s)\*\s|\b(?:config|modes?|options?|steps?|the following|example)\b[^:\n]{0,40}:\s*\z",
    "vague_affirm": r"^\s*(?:(?:yes|yeah|yep|yup|thats?|that'?s|this is|so that'?s)\b[^.!?\n]{0,40}\b(?:that|this|it)\s*[.!]*\s*\z|(?:thats?|that'?s|this is)\s+what\b)",
    "infinitive_lead": r"^\s*to\s+[a-z]",
}
INTENT_CASED = {
    "code_ident": r"(?:::|`[^`]+`|\b[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\b|\b[a-z][a-z0-9]*_[a-z0-9_]+\b|\b[a-z]{1,3}:\d|\.[a-z]{1,4}\b|/[A-Za-z])",
    "tagline": r"^\s*[A-Z][\w./-]*(?:\s+[A-Z][\w./-]*){0,3}\s+[—-]\s+[a-z]",
}
MIN_WORDS, SUBORDINATE_WORDS = 4, 8

# How talk about one's own work begins, and what such talk holds.
PROCESS_HEADS = (
    "i'll take this as", "i'll take that as", "i'll take this", "i'm going to", "im going to", "i need to answer", "i should ", "looking at ", "here's what",
    "heres what", "let's see", "lets see", "let me see", "let me think", "now let me", "now i'll", "first i'll", "i'll start", "i'll begin",
    "i'll continue", "let me check", "let me verify", "let me look",
)
PROCESS_PHRASES = (
    "the user is asking", "the user asked", "the user wants", "the user notes", "the developer notes", "the developer says", "the developer wants",
    "it was a user asking", "it was the user", "so i need to answer", "as a user asking",
)
SOFT_HEADS = ("let me ", "i'll ")

# How questions open, what asks the hearer to act, and verbs that record a choice.
OPENERS = (
    "what ", "why ", "how ", "when ", "where ", "who ", "which ", "is ", "are ", "can ", "could ", "should ", "would ", "do ", "does ", "did ", "will ",
    "shall we", "should we", "can we", "could we",
)
DIRECTIVE = (
    "you need", "you should", "you must", "you can ", "you have to", "please ", "let's ", "lets ", "can you", "could you", "make sure", "go and ",
    "go ahead", "spin up", "i want you", "i need you", "we want you",
)
DECISIONAL = (
    "decide", "decided", "adopt", "adopted", "choose", "chose", "chosen", "pick", "picked", "switch", "switched", "migrate", "migrated", "move to",
    "moved to", "replace", "replaced", "drop", "dropped", "remove", "removed", "deprecate", "deprecated", "disable", "disabled", "default to", "defaults to",
    "standardize on", "settle on", "go with", "went with", "use ", "using ", "introduce", "introduced", "enable", "enabled", "add ", "added", "implement",
    "implemented", "refactor", "refactored", "rework", "rewrite", "rebuild", "wire ", "wired", "port ", "ported", "ship ", "shipped", "land ", "gate ",
    "split ", "merge ", "rename", "renamed", "bound ", "cache ", "will use", "will not", "won't", "we will", "we'll", "resolves", "resolve ",
)

# Words before a subject, subjects without a referent, phrases of a settled choice, verbs of behaviour.
CONJUNCTIONS = ("but", "and", "so", "then", "also", "plus", "yet", "however", "ok", "okay", "well")
UNBOUND = ("it", "its", "this", "that", "thats", "these", "those", "they", "theyre", "them", "their", "there", "theres")
CHOICE_PHRASES = ("decided to", "chose ", "choosing ", "going with ", "switch to ", "adopt ", "migrate to ", "default to ", " by default")
CHOICE_OF_NAMED = ("use ", "keep ", "go with ", "instead of", "rather than")
BEHAVIOUR = ("returns ", " maps ", " routes ", "defaults to", " caps ", " bounds ", "dedup", " emits ", " yields ", " resolves ", " falls back")
REJECTED_AFTER = ("instead of", "rather than", "as opposed to")
CHOSEN_AFTER = ("go with", "switch to", "migrate to", "adopt", "use")
SKILL_OR_GOAL = ("/goal", "your goal is to", "system reminder")
SKILL_LEADS = ("i'll consider using", "active /goal")
MAX_EPITOME, MAX_ANTECEDENT = 320, 2
#: Which marker gives a decision its sentence, least first.
ANCHOR = {"ban": 0, "decision_verb": 1, "action_request": 1, "rejection": 1, "memory": 2, "imperative": 3, "confirmation": 4}

# Prohibition, negation, removal and contrast.
INSTEAD_PIVOTS = (" instead of ", " rather than ", " in favor of ", " in place of ", " over using ")
PROHIBIT = ("will not use", "won't use", "will no longer use", "no longer use", "stop using", "never use", "must not use", "do not use", "we will not", "we won't")
BAN_NEGATORS = ("never", "do not", "don't", "must not", "mustn't", "will not", "won't", "no longer", "cannot", "can't", "shall not", "should not", "shouldn't", "may not")
REMOVAL_LEAD = (
    "drop", "dropped", "remove", "removed", "delete", "deleted", "deprecate", "deprecated", "disable", "disabled", "ban", "banned", "kill", "killed",
    "strip", "stripped", "purge", "purged", "revert", "reverted", "eliminate", "eliminated", "forbid", "forbidden", "retire", "retired",
)
PSEUDO_NEGATION = (
    "no change", "not certain", "not sure", "cannot rule out", "can't rule out", "not clear", "no need to remove", "without removing", "instead of removing",
    "rather than removing", "no longer needed?",
)
DECISION_VERB_HEAD = (
    "use", "add", "drop", "remove", "switch", "adopt", "replace", "migrate", "wire", "port", "rebuild", "rename", "split", "merge", "move", "enable",
    "disable", "introduce", "expose", "make", "keep", "cache", "gate", "persist", "bypass", "resolve", "fix", "update", "refactor", "implement", "create",
    "delete", "forward", "strip", "purge", "revert", "require", "allow", "ship", "default", "deprecate", "support", "store", "swap", "pin", "bound",
)
CHOOSE_VERBS = ("use ", "adopt ", "switch to ", "choose ", "pick ", "go with ")
MAX_OPTION = 60

# Commit messages.
DECISION_PHRASES = (
    "instead of", "rather than", "in favor of", "switch to", "switched to", "switching to", "switch from", "switched from", "switching from", "migrate to",
    "migrated to", "migrating to", "migrate from", "migrated from", "migrating from", "move to ", "moved to ", "moved from", "ported to", "ported from",
    "replace ", "replaced ", "adopt", "decided to", "decision:", "we will not", "we won't", "won't use", "will no longer", "no longer use", "chose ",
    "choose ", "going with", "go with ", "deprecate", "standardize on", "settle on", "drop ", "dropped ",
)
ARCH_TYPES = ("feat", "refactor", "perf")
HOUSEKEEPING_TYPES = ("chore", "docs", "style", "test", "ci", "build")
SKIP_PREFIXES = ("merge ", "merge branch", "merge pull", "wip", "bump ", "release ", "version ", "v0.", "v1.", "v2.", "fixup!", "squash!", "amend")
VAGUE_FIRST = (
    "update", "updates", "updated", "updat", "updating", "fixing", "fix", "fixes", "fixed", "tweak", "tweaks", "tweaked", "wip", "misc", "cleanup",
    "various", "minor", "more", "progress", "stuff", "changes", "change", "improve", "improving", "improvements", "improvement", "tidy", "polish",
    "rework", "force", "bump", "bumping",
)
MAX_FILES, MAX_COMMIT_EPITOME = 40, 240
