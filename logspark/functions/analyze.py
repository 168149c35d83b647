"""Severity and category inference (C1-C16) as built-in column expressions.

The cascade is one ``coalesce`` over per-step ``struct(severity, category,
rule)`` values.  ``coalesce`` and ``CASE WHEN`` evaluate lazily left to
right, so a row stops paying as soon as a step fires - the same early exit
as the rule engine being reproduced, without any Python in the row path.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark.functions.rules import DEFAULT_RULES, Rules

# Java-dialect twins of rules.HTTP_STATUS_REGEXES_RE2.  RE2's \s is
# [\t\n\f\r ] (no vertical tab), \d is ASCII and \b is an ASCII word
# boundary; (?iu) gives Unicode case folding like RE2's (?i).
HTTP_STATUS_REGEXES_JAVA = (
    r"(?iu)(?:status|http|code)[\t\n\f\r :=]*([0-9]{3})",
    r"(?iu)returned[\t\n\f\r ]+([0-9]{3})",
    r"(?<![0-9A-Za-z_])(?iu)([0-9]{3})[\t\n\f\r ]+(?:error|ok|found|not found)",
    r"""(?iu)"status"[\t\n\f\r :]+["']?([0-9]{3})""",
    r"""(?iu)"status_code"[\t\n\f\r :]+["']?([0-9]{3})""",
)
# Words one of which the lower-cased text must contain for the pattern of
# the same position to match; U+017F (long s) case-folds to "s" but is its
# own lower case, so it joins every guard with an "s" in it.
HTTP_STATUS_GUARDS = (
    ("status", "http", "code", "\u017f"),
    ("returned",),
    ("error", "ok", "found"),
    ('"status', '"\u017ftatus', "\u017f"),
    ('"status_code', "\u017f"),
)


#: One of them must be in the text for a service token to be.
SERVICE_MARKS = ("-service", "_service")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shortest(patterns) -> list[str]:
    """The patterns without those that contain another one: a text with one
    of these has the other as well."""
    ps = list(dict.fromkeys(patterns))
    return [p for p in ps if not any(o != p and o in p for o in ps)]


class Found:
    """Which groups of words a text contains something of, found in one pass.

    ``any`` and ``contains`` give each group that is asked for a bit, and test
    it in the column ``name``.  ``captured`` lists words: one regular expression,
    a trie of all words inside a lookahead, captures at every place of the text
    the longest word that begins there.  Shorter words that begin a captured one
    are in the text as well, and words that begin elsewhere are captured at
    their own place, so each captured word sets the bits of all groups that hold
    a beginning of it: ``bits`` makes the column of a column of captured words.
    """

    BITS = 62

    def __init__(self, name: str = "found") -> None:
        self.name = name
        self.groups: dict[tuple[str, ...], int] = {}

    def any(self, words) -> Column:
        bit = self.groups.setdefault(tuple(shortest(words)), len(self.groups))
        mask = F.get(F.col(self.name), F.lit(bit // self.BITS))
        return mask.bitwiseAND(F.lit(1 << bit % self.BITS).cast("bigint")) != 0

    def contains(self, word: str) -> Column:
        return self.any([word])

    def _words(self) -> list[str]:
        return sorted({w for group in self.groups for w in group})

    def captured(self, text) -> Column:
        """The distinct words, of all groups asked for so far."""
        return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(f"(?=({_trie(self._words(), 6)}))"), F.lit(1)))

    def bits(self, captured) -> Column:
        """array<bigint> of captured words, to be the column ``name``."""
        masks = []
        for i in range(0, len(self.groups), self.BITS):
            own = {g: 1 << b - i for g, b in self.groups.items() if i <= b < i + self.BITS}
            words = {w: sum(m for g, m in own.items() if w.startswith(g)) for w in self._words()}
            words = {w: m for w, m in words.items() if m}
            table = F.map_from_arrays(F.split(F.lit("\x1f".join(words)), "\x1f"),
                                      F.split(F.lit("\x1f".join(map(str, words.values()))), "\x1f").cast("array<bigint>"))
            masks.append(F.aggregate(_col(captured), _no_bits(), _setting(table)))
        return F.array(*masks)


def _no_bits() -> Column:
    return F.lit(0).cast("bigint")


def _setting(table: Column):
    return lambda mask, word: mask.bitwiseOR(F.coalesce(F.try_element_at(table, word), _no_bits()))


def _quoted(char: str) -> str:
    return char if char.isalnum() else "\\" + char


def _trie(words, chunk: int = 0) -> str:
    """A regular expression for the longest of the words that fits here;
    with ``chunk``, so many first letters at a time are tried behind a class."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by_first.setdefault(w[:1], []).append(w[1:])
    ends = by_first.pop("", None) is not None
    arms = [_quoted(first) + _trie(rest) for first, rest in by_first.items()]
    if chunk:
        firsts = [_quoted(f) for f in by_first]
        arms = [f"(?=[{''.join(firsts[i:i + chunk])}])(?:{'|'.join(arms[i:i + chunk])})" for i in range(0, len(arms), chunk)]
    whole = arms[0] if len(arms) == 1 and not ends else f"(?:{'|'.join(arms)})" if arms else ""
    return whole + "?" if ends and arms else whole


def contains_any(text, patterns) -> Column:
    """True when ``text`` (a column, or what is ``Found`` in it) contains at
    least one of the literal patterns."""
    if isinstance(text, Found):
        return text.any(patterns)
    t = _col(text)
    out = None
    for p in shortest(patterns):
        hit = t.contains(p)
        out = hit if out is None else (out | hit)
    return out if out is not None else F.lit(False)


def first_match(text, pairs, wrap=None) -> Column:
    """Value of the first ``(pattern, value)`` pair whose pattern ``text``
    contains, in declaration order; NULL when none does."""
    out = None
    if isinstance(text, Found):
        for value, run in groupby(pairs, key=lambda p: p[1]):     # order counts between different values
            v = wrap(value) if wrap is not None else F.lit(value)
            hit = text.any([p for p, _ in run])
            out = F.when(hit, v) if out is None else out.when(hit, v)
        return out if out is not None else F.lit(None)
    t = _col(text)
    seen: list[str] = []
    for pattern, value in pairs:
        if any(o in pattern for o in seen):
            continue  # an earlier pattern is part of it and decides first
        seen.append(pattern)
        v = wrap(value) if wrap is not None else F.lit(value)
        out = F.when(t.contains(pattern), v) if out is None else out.when(t.contains(pattern), v)
    return out if out is not None else F.lit(None)


def parsed_body(body) -> Column:
    """struct(whole, v): whether a body text is one JSON value and nothing
    else, and that value.  The text is parsed once, as the first element of an
    array whose second one is a hash of the text: whatever follows the value
    either breaks the array or moves the hash.  Of equal keys the last wins
    (``enrich`` sets the parser's option)."""
    b = _col(body)
    mark = F.xxhash64(b).cast("string")
    v = F.try_parse_json(F.concat(F.lit("["), b, F.lit(',"'), mark, F.lit('"]')))
    return F.struct(v.alias("v"), mark.alias("mark"))


def whole_body(parsed) -> Column:
    """The value of a ``parsed_body``, NULL unless it is all of the text."""
    p = _col(parsed)
    same = F.try_variant_get(p["v"], "$[1]", "string") == p["mark"]
    return F.when(same, F.try_variant_get(p["v"], "$[0]", "variant"))


def escaped_json(canonical) -> Column:
    """Stored and matched text of a canonical JSON object: <, >, & and the line
    separators U+2028 and U+2029 as escapes, whole numbers without a fraction
    (strings are stepped over, so only numbers change)."""
    c = _col(canonical)
    numbers = F.regexp_replace(c, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|([0-9])\.0(?=[,}\]])', "$1$2")
    c = F.when(c.contains(".0"), numbers).otherwise(c)
    for ch, text in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        c = F.replace(c, F.lit(ch), F.lit(text))
    return c


def searchable_text(title="title", description="description", body="body") -> Column:
    """Title [+ ' ' + description] [+ ' ' + body when it has a key]."""
    b = _col(body)
    return F.concat_ws(
        " ",
        _col(title),
        F.nullif(_col(description), F.lit("")),
        F.when(b != F.lit("{}"), b),
    )


def security_issue(text_lower, rules: Rules = DEFAULT_RULES) -> Column:
    """C4."""
    return contains_any(text_lower, rules.security)


def base_category(text_lower, rules: Rules = DEFAULT_RULES, include_security: bool = True) -> Column:
    """Security, then the word groups in order, else general.

    ``include_security=False`` leaves out the security arm - for use inside
    ``decide``, whose category-keeping steps are only reached after the
    security test has failed.
    """
    t = _col(text_lower)
    out = F.when(security_issue(t, rules), F.lit("security")) if include_security else None
    for name, words in rules.category_words:
        hit = contains_any(t, words)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("general"))


def _json_number_or_int_string(v) -> Column:
    """Integer value of a JSON number (truncated toward zero) or of a JSON
    string holding a strict base-10 integer; NULL otherwise."""
    kind = F.schema_of_variant(v)
    as_number = F.try_variant_get(v, "$", "double").try_cast("bigint")
    s = F.try_variant_get(v, "$", "string")
    return (
        F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), as_number)
        .when((kind == "STRING") & s.rlike("^[+-]?[0-9]+$"), s.try_cast("bigint"))
    )


def body_duration_ms(body_v, rules: Rules = DEFAULT_RULES, body_text=None) -> Column:
    """First positive duration among the body's duration keys.

    With ``body_text`` (the canonical body text) the typed variant lookups
    only run for bodies whose text contains one of the quoted key names -
    exact, since a top-level key always appears quoted in the text.
    """
    bv = _col(body_v)
    arms = []
    for key in rules.duration_fields:
        d = _json_number_or_int_string(F.try_variant_get(bv, f"$.{key}", "variant"))
        arms.append(F.when(d > 0, d))
    value = F.coalesce(*arms)
    if body_text is None:
        return value
    # "duration" also covers "duration_ms"; likewise elapsed / latency
    stems = sorted({k for k in rules.duration_fields
                    if not any(k != o and k.startswith(o) for o in rules.duration_fields)})
    return F.when(contains_any(_col(body_text), [f'"{k}' for k in stems]), value)


def duration_level(ms, rules: Rules = DEFAULT_RULES) -> Column:
    """Fast / normal / slow / critical."""
    m = _col(ms)
    out = None
    for bound, level in rules.duration_levels:
        out = F.when(m < bound, F.lit(level)) if out is None else out.when(m < bound, F.lit(level))
    return out.otherwise(F.lit(rules.duration_top_level))


def level_severity(level, rules: Rules = DEFAULT_RULES) -> Column:
    """C9."""
    lv = _col(level)
    out = None
    for name, sev in rules.level_severity:
        out = F.when(lv == name, F.lit(sev)) if out is None else out.when(lv == name, F.lit(sev))
    return out


def http_status_code(text, text_lower=None) -> Column:
    """Status code text from the first pattern that matches, else NULL.

    With ``text_lower`` each regex only runs when its guard words occur
    (exact: a match needs one of them), so most rows skip the regexes.
    """
    t = _col(text)
    arms = []
    for p, guard in zip(HTTP_STATUS_REGEXES_JAVA, HTTP_STATUS_GUARDS):
        found = F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
        arms.append(found if text_lower is None else F.when(contains_any(_col(text_lower), guard), found))
    return F.coalesce(*arms)


def http_status_severity(code, rules: Rules = DEFAULT_RULES) -> Column:
    """C11: severity of a listed status code, NULL for unlisted ones.

    A constant map lookup, so the (regex-extracted) code is evaluated once.
    """
    table = F.create_map(*[F.lit(x) for pair in rules.http_status for x in pair])
    return F.try_element_at(table, _col(code))


def stack_trace(text_lower, rules: Rules = DEFAULT_RULES) -> Column:
    """Any stack marker, case-insensitive."""
    return contains_any(text_lower, [m.lower() for m in rules.stack_markers])


def keyword_severity(text_lower, rules: Rules = DEFAULT_RULES) -> Column:
    """Error -> warning -> success -> debug keywords, else info."""
    t = _col(text_lower)
    out = None
    for sev, words in rules.keyword_groups:
        hit = contains_any(t, words)
        out = F.when(hit, F.lit(sev)) if out is None else out.when(hit, F.lit(sev))
    return out.otherwise(F.lit(rules.default_severity))


def _verdict(severity, category, rule) -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    cat = F.lit(category) if isinstance(category, str) else category
    return F.struct(sev.alias("severity"), cat.alias("category"), F.lit(rule).alias("rule"))


def decide(text="text", text_lower="text_lower", duration_ms="duration_ms", category="base_category",
           rules: Rules = DEFAULT_RULES, severity_needed=None) -> Column:
    """The ordered cascade; returns struct(severity, category, rule).

    Expects the searchable text, its lower-case form (or what is ``Found`` in
    it), the body duration (``body_duration_ms``) and the base category as already materialised
    columns, so nothing below is evaluated twice.

    ``severity_needed`` (a boolean column) skips the keyword-severity scan
    where the caller will discard the inferred severity anyway; the last
    step then yields a NULL severity, while category and rule are unchanged.
    """
    t, tl, dur, cat = _col(text), _col(text_lower), _col(duration_ms), _col(category)
    security = F.when(security_issue(tl, rules), _verdict("critical", "security", "security"))
    business = first_match(tl, rules.business, wrap=lambda s: _verdict(s, "business", "business"))
    perf_text = first_match(tl, rules.performance, wrap=lambda s: _verdict(s, "performance", "performance"))
    perf_body = F.when(dur.isNotNull(), _verdict(level_severity(duration_level(dur, rules), rules),
                                                  "performance", "duration"))
    http_table = F.create_map(*[x for status, sev in rules.http_status
                                for x in (F.lit(status), _verdict(sev, "http", "http_status"))])
    http = F.try_element_at(http_table, http_status_code(t, tl))
    stack = F.when(stack_trace(tl, rules), _verdict("error", cat, "stack_trace"))
    database = first_match(tl, rules.database, wrap=lambda s: _verdict(s, "database", "database"))
    system = first_match(t, rules.system_codes, wrap=lambda s: _verdict(s, "system", "system_code"))
    kw = keyword_severity(tl, rules)
    if severity_needed is not None:
        kw = F.when(severity_needed, kw)
    keywords = _verdict(kw, cat, "keywords")
    return F.coalesce(security, business, perf_text, perf_body, http, stack, database, system, keywords)
