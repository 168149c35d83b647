"""Originating-service inference (D1-D7) as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logspark.functions.analyze import SERVICE_MARKS, Found, contains_any
from logspark.functions.rules import DEFAULT_RULES, SERVICE_TOKEN_TRIM, Rules

# Unicode White_Space, the set Go's strings.TrimSpace / strings.Fields use.
_WS = r"\p{IsWhite_Space}"
_SERVICE_TOKEN = rf"(?<![^{_WS}])([^{_WS}]*[-_]service[^{_WS}]*)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_string_field(body_v, key: str) -> Column:
    """Top-level ``key`` of a parsed body when it is a non-empty JSON string
    (numbers, booleans, objects and arrays give NULL)."""
    v = F.try_variant_get(_col(body_v), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING",
                  F.nullif(F.try_variant_get(v, "$", "string"), F.lit("")))


def body_field_source(body_v, rules: Rules = DEFAULT_RULES, body_text=None) -> Column:
    """First of service, source, app, ... holding a non-empty string.

    With ``body_text`` (canonical body text) a field is only looked up when
    its quoted name occurs in the text - exact, and it skips the typed
    variant lookups for almost every body.
    """
    arms = []
    for k in rules.source_body_fields:
        v = json_string_field(body_v, k)
        arms.append(v if body_text is None else F.when(_col(body_text).contains(f'"{k}"'), v))
    return F.coalesce(*arms)


def trim_space(c) -> Column:
    """Strip leading/trailing Unicode white space."""
    return F.regexp_replace(_col(c), rf"^{_WS}+|{_WS}+$", "")


def title_prefix_source(title) -> Column:
    """D3 + D4: ``[name]`` prefix, else ``name:`` with the first colon at
    byte offset 1..19 and no blank in the trimmed name; lower-cased."""
    t = _col(title)
    bracket = F.when(t.startswith("["), F.nullif(F.regexp_extract(t, r"^\[([^\]]+)\]", 1), F.lit("")))
    head = F.substring_index(t, ":", 1)
    offset = F.octet_length(head)
    name = trim_space(head)
    colon = F.when(
        (F.instr(t, ":") > 0) & (offset > 0) & (offset < 20),
        F.when((name != "") & ~name.contains(" "), name),
    )
    return F.lower(F.coalesce(bracket, colon))


def smart_source(text_lower, rules: Rules = DEFAULT_RULES) -> Column:
    """Ordered keyword groups -> service name (database refined by engine)."""
    t = _col(text_lower)
    out = None
    for name, any_of, all_of, none_of in rules.source_rules:
        cond = contains_any(t, any_of) if any_of else F.lit(True)
        for w in all_of:
            cond = cond & t.contains(w)
        for w in none_of:
            cond = cond & ~t.contains(w)
        value = F.lit(name)
        if name == "database-service":
            refine = None
            for word, engine in rules.database_source_refinement:
                refine = (F.when(t.contains(word), F.lit(engine)) if refine is None
                          else refine.when(t.contains(word), F.lit(engine)))
            value = refine.otherwise(F.lit(name))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def service_token(text_lower, found=None) -> Column:
    """First blank-separated token containing -service / _service,
    surrounding punctuation trimmed (the regex only runs when one of the
    two strings occurs)."""
    t = _col(text_lower)
    token = F.nullif(F.regexp_extract(t, _SERVICE_TOKEN, 1), F.lit(""))
    return F.when(contains_any(found or t, SERVICE_MARKS), F.btrim(token, F.lit(SERVICE_TOKEN_TRIM)))


def derive_source(source="source", body_v="body_v", title="title", text_lower="text_lower",
                  rules: Rules = DEFAULT_RULES, body_text=None, found: Found | None = None) -> Column:
    """Header source, body field, title prefix, keywords, service token."""
    return F.coalesce(
        F.nullif(_col(source), F.lit("")),
        body_field_source(body_v, rules, body_text),
        title_prefix_source(title),
        smart_source(found or text_lower, rules),
        service_token(text_lower, found),
    )
