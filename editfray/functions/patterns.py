"""The patterns that the text rules are defined by. (?iU) makes \\b and \\w know Unicode."""

_I = "(?iU)"
REVERT_LIVE = _I + r"\b(revert(?:ed|ing)?|undid|undo|rollback|rvv?|restore[ds]?)\b"
REVERT_SEGMENT = _I + r"\b(revert(?:ed|ing)?|rvv?|rollback|undid|undo)\b"
REVISION_NUMBER = _I + r"\b(?:revision|rev(?:ision)?id?)\s+(\d+)\b"
BY_USER = (
    _I + r"\bby\s+\[\[(?:Special:Contributions/)?([^|\]]+)(?:\|[^\]]+)?\]\]",
    _I + r"\bby\s+([^:;,.()]+?)(?:\s+\(|$)",
    _I + r"\bReverted edits by\s+([^:;,.()]+)",
)
CLEANUP = _I + r"\b(vandal(?:ism|s)?|rvv|graffiti|blank(?:ing|ed)?|test edit|nonsense|spam|hoax|unconstructive)\b"
GENERATED = (
    _I + r"(?:^|\b)(?:undid|undo|reverted|revert|rollback)\b[^\n]{0,140}\brevision\s+\d+\b"
    r"|^\s*revision\s+\d+\s+by\s*(?:\([^)]*\))?\s*$|^\s*reverted\s+(?:\d+\s+)?edits?\s+by\b"
)
GENERIC_ACTION = _I + r"^(?:rvv?|revert(?:ed|ing)?|undo|undid|rollback|restore(?:d)?|copyedit|ce|cleanup|fix(?:ed)?)\b[:\s-]*"
WORD = r"[A-Za-z0-9][A-Za-z0-9'’\-–]*"
WIKILINK = r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]"
TEMPLATE = r"\{\{[^{}]*\}\}"
REF = r"(?is)<ref\b[^>]*>.*?</ref>|<ref\b[^/]*/>"
TAG = r"<[^>]+>"
SECTION = r"(?U)={2,}\s*([^=]+?)\s*={2,}"
STOPWORDS = ("about", "after", "also", "because", "been", "being", "from", "have", "into", "that", "their", "there", "these", "this", "those", "were", "with", "would")
ROUTINE_TITLE = (
    _I + r"\b(list of|season|championship|championships|tournament|cup|league|roster|squad|standings|results|statistics|records|record|draft|episode|"
    r"episodes|discography|filmography|awards?|medal table|schedule|rankings?|transfers)\b"
)
STRONG_ROUTINE_TITLE = (
    _I + r"\b(list of (?:programs|episodes|missions|champions|winners|awards|records|songs|singles|albums|characters|players|squads|rosters|results|"
    r"standings|rankings)|episodes?|discography|filmography|roster|squad|standings|results|schedule|statistics|rankings?|transfers)\b"
)
SEASON_TITLE = _I + r"\b(?:18|19|20)\d{2}(?:[-–]\d{2})?\b.*\b(season|championship|tournament|cup|league|draft|election results)\b"
TALK_RFC = _I + r"\b(rfc|rfc/u|request(?:s|ed)? for comment|requested comment|request for comments)\b"
TALK_ARBITRATION = (
    _I + r"\b(arbcom|arbitration|arbitration enforcement|wp:ae|ae noticeboard|discretionary sanctions|contentious topic|contentious topics|arbcom case)\b"
)
TALK_RESTRICTION = (
    _I + r"\b(page protection|protected|semi-protected|fully protected|full protection|extended[- ]confirmed|extendedconfirmed|ecp|pending changes|"
    r"edit restriction|editing restriction|topic ban|1rr|0rr|500/30|move protected|protection request|requested protection)\b"
)
ROUTINE_TALK = r"^(reverted edits by|undid revision|rollback|automated)"
STRONG_DEBATE = _I + r"\b(consensus|discuss(?:ion)?|debate|dispute|edit war|npov|pov|neutral|undue|rfc|requested comment|wording|bias|controvers)\b"
SOURCE_DEBATE = _I + r"\b(reliable source|source|citation|lead)\b"
REVERT_TAGS = (("mw-rollback", 0.95), ("mw-undo", 0.9), ("mw-manual-revert", 0.85))
