"""Word lists and patterns the scoring and detection rules are parameterised with.

Every rule takes a :class:`Lexicon`; ``ENGLISH`` is the default one.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Results only agree when these lists and patterns are the same.
# ---------------------------------------------------------------------------
STOP_WORDS = (
    "a an and are as at be but by for from has have i if in is it its of on or "
    "that the this to was were will with you your we our my me he she they them "
    "so do does did not no yes can could would should about into like just really "
    "what when where which who how part where's there here then than very whether "
    "while because since though although"
)
TASK_WORDS = (
    "make create cut clip clips clipping video videos short shorts highlight highlights "
    "moment moments part parts section sections segment segments bit bits piece "
    "find give show pull extract grab take get want need please one two three "
    "second seconds minute minutes long around roughly max min best good great "
    "talk talks talking says said say discuss discussing mention mentions"
)
FILLER = r"\b(?:uh|um|hmm|like|you know)\b"
DECISION = (
    r"\b(?:we should|we need|the goal|decid|agree|requirement|question|problem|"
    r"idea|plan|next step|takeaway|lesson|because|so that)\b"
)
EXPLAIN = (
    r"\b(?:because|the reason|which means|that's why|the way to|here's how|here is how|how to|the trick|"
    r"it works by|turns out|in other words|the idea is|the point is|what that means)\b"
)
DECIDE = (
    r"\b(?:we should|we need|the rule|requirement|we decided|decision|never|always|must|has to|"
    r"the goal|next step|hard requirement|non-negotiable)\b"
)
HOW_TO = (
    r"\b(?:you can|you just|instead of|rather than|make sure|the fix|the answer|the key|the lesson|"
    r"lessons? learned|takeaway|what i learned|surprised|impressed|first,|then,|step)\b"
)
NUMBER = r"\b\d+(?:[.,]\d+)?\s*(?:%|percent|x|times|minutes?|hours?|seconds?|days?|weeks?|k|m|ms)?\b"
BANTER = (
    r"\b(?:can you (?:hear|see) (?:me|my screen)|share my screen|let me share|hold on|one sec|hang on|"
    r"we(?:'re| are) recording|hadn't been recording|just joined|joined late|hi everyone|hey everyone|"
    r"welcome back|thanks for (?:joining|coming)|good morning|good afternoon|how are you|how's it going|"
    r"lol|haha|mute|unmute|back in a (?:sec|minute)|are you there|can everyone|let me know if)\b"
)
DECISION_LABEL = r"\b(?:we should|we need|let's|the goal|decid\w*|agree\w*|next step|the plan|plan is)\b"
DEMO_LABEL = (
    r"\b(?:share my screen|let me show|i'll show|show you|you can see|let's run|watch this|demo|on my screen)\b"
)
HARD_FILLERS = "um umm uh uhh uhm ah er erm hmm hm mm mhm"
SOFT_FILLERS = "like"
CLAUSE_END = r"[,.?!;:…]\s*$"
TERMINAL = "[.!?]+[\"'”’)\\]]*$"

# Debris a removed filler leaves behind, in the order it is repaired: (pattern, replacement).
CLEANUP = (
    (r"(?:^|\s)-(?=\s|$)", " "),
    (r"\s*,(?:\s*,)+", ","),
    (r"([.!?;:])\s*,(?=\s|$)", "$1"),
    (r"\s+([,.!?;:])(?=\s|$)", "$1"),
    (r"\s+", " "),
)

# Setup phrases a sentence cannot end on (all matched on lower-cased text).
SETUP_NOUN = (
    "thing|part|idea|trick|point|reason|key|secret|question|problem|catch|kicker|"
    "takeaway|difference|lesson|goal|plan|result|answer|bit|news|beauty|magic|insight|benefit|"
    "advantage|upshot|bottom line|punchline|hack|cool part|nice part"
)
SETUP_OPENER = (
    r"(?:^|,\s*)(?:[-–—]\s*)?(?:(?:and|so|but|now|okay|ok|well|plus|because|then|like|uh|um|you know|i mean|"
    r"i think|honestly|actually|basically)[,]?\s+)*"
)
SETUP_PATTERNS = (
    SETUP_OPENER + r"(?:the|a|my|our|one|another|this|that|other)\s+(?:[\w'-]+\s+){0,3}(?:" + SETUP_NOUN + r")\s+"
    r"(?:(?:here|there|about (?:it|this|that))\s+)?(?:is|was|being|are|were)$",
    r"\b(?:this|here)(?:'s| is)\s+(?:the|my|a|one|another)\s+(?:[\w'-]+\s+){0,2}(?:" + SETUP_NOUN + r")"
    r"(?:\s+about(?:\s+(?:uh|um))?(?!\s+(?:it|this|that|them|him|her|you)$)(?:\s+[\w'-]+){1,3})?$",
    SETUP_OPENER + r"(?:what(?:'s| is| was)?|the way|how)\b(?:\s+[\w'-]+){0,5}\s+(?:is|was)$",
    r"\bhere(?:'s| is)(?:\s+(?:the\s+[\w'-]+|what|how|why|where|who|one|another|a))?$",
    r"\b(?:let me show you|i'll show you|i can show you|watch this|check this out|look at this|"
    r"for example|for instance|such as|you know what|guess what|get this|and then|"
    r"so what (?:i|we|it|you) (?:did|do|does) (?:is|was)|it turns out|turns out|"
    r"the answer is|it's basically|basically it's)$",
    r"^(?:(?:um|uh|okay|ok|so|and|oh)[,]?\s+)*(?:hold on|one sec(?:ond)?|where was i)$",
    SETUP_OPENER + r"(?:(?:i don't know how )?else to (?:show|explain|do)|"
    r"let me (?:just )?(?:find|pull|open|scroll|share))\b",
)
SETUP_FINISHED = (
    r"^(?:what|which|how|why|where|the way)\s+(?:it|that|this|he|she|they|you|we|i|things|life)"
    r"(?:\s+(?:just|always|really))?\s+(?:is|was)$"
)
SETUP_RHETORICAL = r"\b(?:you know what|guess what|and then what|know why)$"
OPEN_WORDS = "and but or because the a an if gonna whether unless plus than"

# Private details: one pattern per kind.
SENSITIVE = {
    "email": r"[\w.+-]+ ?@ ?[\w-]+(?:\.[\w-]+)+",
    "phone": r"(?<![\w.])(?:(?:\+?1[\s.-])?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
             r"|\+\d{1,3}(?:[\s.-]?\(?\d{1,5}\)?){2,5})(?![\w])",
    "ssn": r"(?<!\d)\d{3}[- ]\d{2}[- ]\d{4}(?!\d)",
    "card": r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)",
    "key": r"(?:sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|xox[abprs]-[\w-]{10,}"
           r"|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{30,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]*)",
    "money": r"(?<![\w$])(?:[$€£]\s?\d[\d,]*(?:\.\d+)?(?:\s?[kKmMbB]\b)?|\d[\d,]*(?:\.\d+)?\s?(?:USD|EUR|GBP|dollars)\b)",
    "url": r"(?i)(?:https?://)?(?:[\w-]+\.)+[a-z]{2,}(?:/[^\s]*)?"
           r"(?:/(?=\w*\d)\w{6,}(?![\w.-])|[?#](?=\S*\d)\S+)\S*",
    "token": r"(?<![\w/])(?=[A-Za-z0-9_\-+/=]*\d)(?=[A-Za-z0-9_\-+/=]*[A-Za-z])[A-Za-z0-9_\-+/=]{24,}(?![\w/])",
}
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Lexicon:
    """The vocabulary of one language or domain. Patterns are Java regular expressions."""

    stop_words: tuple[str, ...] = tuple(STOP_WORDS.split())
    task_words: tuple[str, ...] = tuple(TASK_WORDS.split())
    filler: str = FILLER
    decision: str = DECISION
    explain: str = EXPLAIN
    decide: str = DECIDE
    how_to: str = HOW_TO
    number: str = NUMBER
    banter: str = BANTER
    decision_label: str = DECISION_LABEL
    demo_label: str = DEMO_LABEL
    hard_fillers: tuple[str, ...] = tuple(HARD_FILLERS.split())
    soft_fillers: tuple[str, ...] = tuple(SOFT_FILLERS.split())
    suffixes: tuple[str, ...] = ("ing", "ed", "es", "s")
    setup_patterns: tuple[str, ...] = SETUP_PATTERNS
    setup_finished: str = SETUP_FINISHED
    setup_rhetorical: str = SETUP_RHETORICAL
    open_words: tuple[str, ...] = tuple(OPEN_WORDS.split())


ENGLISH = Lexicon()
