"""Results of the knowledge backend, held against the contract of the capability that was asked for, and brought into one form.

A result is a row with a JSON body of any nesting. Each capability is an ordered list of checks over the VARIANT that the body
parses to, compiled into one projection: no Python, no shuffle, and a result's items are never dealt out to rows. The first
check that fails names the ``status`` and ``detail`` of the row, as its reader would meet it. Checks are SQL text, each parsed once: the same as
column objects takes ten times as long to put together. What checks share is worked out once a row: fields, the members of lists and
the texts of members are columns of their own, and inside a check a value that is looked at more than once has a name.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.functions.text import instant

MAX_ITEMS = 100
MAX_PRIMARY = 50
MAX_ANSWER = 16_384
MAX_CONTEXT = 65_536
MAX_SUMMARY = 2_048
MAX_TITLE = 512
SAFE_INTEGER = 2**53 - 1
# What a result may say.
REVIEW_REASONS = ("all", "connector-fetched", "contradicted", "imported-okf", "low-confidence", "manual-review-requested", "provenance-violating", "schema-violating")
PENDING = ("changed", "deleted", "new")
STATES = ("corrupt", "missing", "ok", "too-new")
EMPTY_STATES = ("corrupt", "too-new")
SEVERITIES = ("error", "info", "warning")
REFERENCE_KINDS = ("chunk", "index", "page")
CAPABILITIES = ("compile", "context", "eval-fast", "eval-full", "lint", "query", "search", "status")
# Shapes of codes, parts of page ids, page ids, candidates.
CODE = r"\A[a-z0-9][a-z0-9._-]{0,127}\z"
PART = r"\A(?!\.{1,2}\z)[^/\\:\x00-\x1F\x7F-\x9F]{1,255}\z"
NAMESPACE = r"\A[a-z0-9][a-z0-9-]*\z"
SLUG = r"\A[a-z0-9]+(?:-[a-z0-9]+)*\z"
CANDIDATE = r"\A[a-z0-9]+(?:-[a-z0-9]+)*-[a-f0-9]{8}\z"

def _at(value: str, path: str) -> str:
    """What lies at a path: SQL null where nothing does, a VARIANT null where the JSON says null."""
    return f"try_variant_get({value}, '$.{path}', 'variant')"


def _sure(condition: str) -> str:
    return f"coalesce({condition}, false)"


def _let(value: str, use) -> str:
    """``use`` of a name for the value, which is worked out once; a value has the same name everywhere."""
    name = f"v{zlib.crc32(value.encode())}"
    return f"element_at(transform(array({value}), {name} -> {use(name)}), 1)"


def _rlike(text: str, pattern: str) -> str:
    return f"rlike({text}, r'{pattern}')"


def _is(value: str, *kinds: str) -> str:
    """Whether a value is of one of the kinds; decimals have their digits behind the name."""
    return _sure(_let(f"schema_of_variant({value})", lambda k: f"{k} IN ({', '.join(map(repr, kinds))})" + (f" OR startswith({k}, 'DECIMAL')" if "DECIMAL" in kinds else "")))


def _record(value: str) -> str:
    return f"try_variant_get({value}, '$', 'struct<_: variant>') IS NOT NULL"


def _boolean(value: str) -> str:
    return _is(value, "BOOLEAN")


def _string(value: str) -> str:
    """The text of a JSON string; null for any other value."""
    return _let(value, lambda v: f"if(schema_of_variant({v}) = 'STRING', try_variant_get({v}, '$', 'string'), null)")


def _number(value: str) -> str:
    return _let(value, lambda v: f"if({_is(v, 'BIGINT', 'DOUBLE', 'FLOAT', 'DECIMAL')}, try_variant_get({v}, '$', 'double'), null)")


def _items(value: str) -> str:
    """The members of a JSON array; null for any other value."""
    return f"try_variant_get({value}, '$', 'array<variant>')"


def _members(value: str) -> str:
    return f"coalesce({_items(value)}, cast(array() AS array<variant>))"


def _units(text: str) -> str:
    """The number of UTF-16 units."""
    return rf"length({text}) + regexp_count({text}, r'[\x{{10000}}-\x{{10FFFF}}]')"


def _plain(text: str, most: int) -> str:
    return rf"length({text}) <= {most} AND {_units(text)} <= {most} AND NOT {_rlike(text, r'[\x00\x1B]')}"


def _text(value: str, most: int) -> str:
    """A string of at most ``most`` UTF-16 units without NUL and escape characters."""
    return _let(_string(value), lambda t: _sure(_plain(t, most)))


def _like(value: str, pattern: str, most: int) -> str:
    return _let(_string(value), lambda t: _sure(f"{_plain(t, most)} AND {_rlike(t, pattern)}"))


def _among(value: str, allowed: tuple[str, ...]) -> str:
    return _sure(f"{_string(value)} IN ({', '.join(map(repr, allowed))})")


def _list(value: str, most: int = MAX_ITEMS) -> str:
    return _sure(f"size({_items(value)}) <= {most}")


def _list_of(value: str, member: str, good: str, most: int = MAX_ITEMS) -> str:
    """An array of at most ``most`` members, for each of which ``good`` holds, which calls it ``member``."""
    return _let(_items(value), lambda i: f"({_sure(f'size({i}) <= {most}')} AND {_sure(f'forall({i}, {member} -> {good})')})")


def _range(value: str, least: float, most: float) -> str:
    return _sure(f"{_number(value)} BETWEEN {least} AND {most}")


def _count(value: str) -> str:
    return _let(_number(value), lambda n: _sure(f"{n} BETWEEN 0 AND {SAFE_INTEGER} AND floor({n}) = {n}"))


def _part(value: str) -> str:
    return _like(value, PART, 255)


def _page_id(value: str) -> str:
    halves = lambda t: f"size(split({t}, '/')) = 2 AND {_rlike(f'split_part({t}, {chr(39)}/{chr(39)}, 1)', NAMESPACE)} AND {_rlike(_slug_of(t), PART)}"
    return _let(_string(value), lambda t: _sure(f"{_plain(t, 320)} AND {halves(t)}"))


def _slug_of(page_id: str) -> str:
    return f"split_part({page_id}, '/', 2)"


def _relative_path(value: str) -> str:
    odd = lambda t: _rlike(t, r"[\x00-\x1F\x7F-\x9F\\:]")
    parts = lambda t: f"forall(split({t}, '/'), p -> p NOT IN ('', '.', '..'))"
    return _let(_string(value), lambda t: _sure(f"{_plain(t, 512)} AND NOT {odd(t)} AND {parts(t)}"))


def _strings(value: str, path: str | None = None) -> str:
    """The texts of an array's members, or of what lies at a path in each."""
    return f"transform({_members(value)}, s -> {_string(_at('s', path) if path else 's')})"


def _distinct(texts: str) -> str:
    return _let(texts, lambda t: f"size(array_distinct({t})) = size({t})")


def _ordered(texts: str) -> str:
    """Texts by their UTF-16 units."""
    return f"transform(array_sort(transform({texts}, o -> struct(encode(o, 'UTF-16BE') AS by, o AS text))), o -> o.text)"


class _Contract:
    """The checks of one capability in their order, and what an accepted result says."""

    def __init__(self, name: str):
        self.name = name
        self.checks: list[tuple[str, str, str | Column]] = []
        self.outcome, self.items, self.counts, self.warnings = "'succeeded'", "array()", {}, "array()"
        #: Columns of fields by path, of their members, and of the texts and numbers taken from either.
        self.fields: dict[str, str] = {}
        self.taken: list[str] = []

    def field(self, path: str) -> str:
        return self.fields.setdefault(path, f"_{self.name.replace('-', '_')}_f{len(self.fields)}")

    def need(self, detail: str, good: str | Column, status: str = "contract") -> None:
        self.checks.append((status, detail, good))

    def count(self, path: str, name: str) -> None:
        value = self.field(path)
        self.need(path, _count(value))
        self.taken += [_count(value), _number(value)]
        self.counts[name] = f"if({_count(value)}, cast({_number(value)} AS bigint), null)"

    def warned(self) -> None:
        value = self.field("warnings")
        self.need("warnings", f"{value} IS NULL OR {_list_of(value, 'w', _record('w') + ' AND ' + _like(_at('w', 'code'), CODE, 128))}")
        self.warnings = self.strings(value, "code")

    def strings(self, value: str, path: str | None = None) -> str:
        """``_strings`` of a field, which checks may share."""
        self.taken.append(_strings(value, path))
        return self.taken[-1]

    def shared(self) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
        """Columns by name in three steps, each made of those before: fields, members, and what is taken from them."""
        prefix = f"_{self.name.replace('-', '_')}"
        fields = {name: _at("_body", path) for path, name in self.fields.items()}
        members = {f"{name}i": _items(name) for name in fields}
        told = "\n".join([x for *_, x in self.checks if isinstance(x, str)] + [self.outcome, self.items, *self.counts.values(), self.warnings])
        members = {name: text for name, text in members.items() if text in told}
        taken = {f"{prefix}_t{i}": text for i, text in enumerate(sorted(set(self.taken), key=len, reverse=True)) if told.count(text) > 1}
        return fields, members, taken

    def told(self) -> Column:
        _, members, taken = self.shared()

        def brief(text: str) -> str:
            return _members_named(text, taken | members)

        verdict = F.lit(None).cast("struct<status: string, detail: string>")
        for status, detail, good in reversed(self.checks):
            bad = ~(F.expr(brief(good)) if isinstance(good, str) else good)
            verdict = F.when(bad, F.struct(F.lit(status).alias("status"), F.lit(detail).alias("detail"))).otherwise(verdict)
        counts = ", ".join(f"'{name}', {value}" for name, value in self.counts.items())
        said = (f"{self.outcome} AS outcome", f"cast({self.items} AS array<string>) AS items", f"cast(map({counts}) AS map<string, bigint>) AS counts", f"cast({self.warnings} AS array<string>) AS warnings")
        return F.struct(verdict.alias("verdict"), F.expr(brief(f"struct({', '.join(said)})")).alias("said"))


def _compile() -> _Contract:
    c = _Contract("compile")
    errors, pages, candidates, review = (c.field(p) for p in ("errors", "pages", "candidates", "review"))
    c.need("errors", _list(errors))
    c.need("errors", f"size({_members(errors)}) = 0", "failed")
    for name in ("compiled", "deleted", "skipped"):
        c.count(name, name)
    c.need("concepts", _list(c.field("concepts")))
    c.need("pages", _list_of(pages, "x", f"if({_sure(f'contains({_string(chr(120))}, {chr(39)}/{chr(39)})')}, {_page_id('x')}, {_part('x')})"))
    ids = f"transform({c.strings(pages)}, x -> if(contains(x, '/'), x, concat('concepts/', x)))"
    c.need("pages:repeated", _distinct(ids))
    named, held, forced = c.strings(candidates), _at(review, "held"), _at(review, "forced")
    c.need("candidates", f"{candidates} IS NULL OR {_list_of(candidates, 'x', _like('x', CANDIDATE, 320))}")
    c.need("candidates:repeated", _distinct(named))
    c.need("review", f"if({review} IS NULL, size({named}) = 0, {_record(review)})")
    own_id, slug, reasons = _at("x", "id"), _at("x", "slug"), _at("x", "reasons")
    bound = _sure(f"length({_string(own_id)}) = length({_string(slug)}) + 9 AND startswith({_string(own_id)}, concat({_string(slug)}, '-'))")
    why = f"{_list_of(reasons, 'r', _among('r', REVIEW_REASONS))} AND size({_members(reasons)}) > 0 AND {_distinct(_strings(reasons))}"
    for name, side in (("held", held), ("forced", forced)):
        c.need(f"review.{name}", f"{review} IS NULL OR {_list_of(side, 'x', ' AND '.join((_record('x'), _like(slug, SLUG, 255), _like(own_id, CANDIDATE, 320), bound, why)))}")
    reviewed = f"concat({_strings(held, 'id')}, {_strings(forced, 'id')})"
    c.need("review:other-ids", f"{_distinct(reviewed)} AND array_sort({reviewed}) = array_sort({named})")
    c.items = _ordered(ids)
    c.counts["candidates"] = f"size({reviewed})"
    c.outcome = f"if({c.counts['compiled']} = 0 AND {c.counts['deleted']} = 0, 'unchanged', 'succeeded')"
    return c


def _status() -> _Contract:
    c = _Contract("status")
    pending, state = c.field("pendingChanges"), c.field("stateStatus")
    file, change = _at("x", "file"), _at("x", "status")
    c.need("pendingChanges", _list_of(pending, "x", " AND ".join((_record("x"), _text(file, 255), _text(change, 32)))))
    plain = _sure(_rlike(_string(file), r"\A[^/\\\x00-\x1F\x7F-\x9F]*\.md\z"))
    c.need("pendingChanges", f"forall({_members(pending)}, x -> {plain} AND {_among(change, PENDING)})", "unsafe-item")
    c.count("pendingChangesCount", "pending")
    files = c.strings(pending, "file")
    c.need("pendingChangesCount:fewer", f"{c.counts['pending']} >= size({files})")
    c.need("pendingChanges:repeated", _distinct(files))
    c.need("stateStatus", _among(state, STATES))
    c.need("stateStatus:pending", f"NOT {_among(state, EMPTY_STATES)} OR {c.counts['pending']} = 0")
    c.need("pages", _record(c.field("pages")))
    totals = {"stalePages": "stale", "orphanedPages": "orphaned"}
    for field in totals:
        c.need(field, _list_of(c.field(field), "x", _part("x")))
    for name in totals.values():
        c.count(f"{name}Count", name)
    last = c.field("lastCompiledAt")
    text = F.expr(_string(last))
    c.need("lastCompiledAt", F.expr(_is(last, "VOID")) | F.expr(_text(last, 64)) & F.coalesce(instant(text) == text, F.lit(False)))
    for field, name in totals.items():
        c.need(f"{name}Count:fewer", f"{c.counts[name]} >= size({_members(c.field(field))})")
        c.need(f"{field}:repeated", _distinct(c.strings(c.field(field))))
    for path, name in (("pages.total", "pages"), ("pendingCandidates", "candidates"), ("sources", "sources")):
        c.count(path, name)
    c.warned()
    c.items = _ordered(files)
    return c


def _lint() -> _Contract:
    c = _Contract("lint")
    found, line = c.field("results"), _at("x", "line")
    c.need("results", _list_of(found, "x", " AND ".join((_record("x"), _among(_at("x", "severity"), SEVERITIES), f"({line} IS NULL OR {_count(line)})", _relative_path(_at("x", "file")), _like(_at("x", "rule"), CODE, 128)))))
    totals = {"errors": "error", "info": "info", "warnings": "warning"}
    for name in totals:
        c.count(name, name)
    for name, severity in totals.items():
        c.need(f"{name}:total", f"{c.counts[name]} = size(filter({c.strings(found, 'severity')}, t -> t = '{severity}'))")
    c.items = _ordered(f"array_distinct({c.strings(found, 'file')})")
    return c


def _evaluation(suite: str) -> _Contract:
    c = _Contract(f"eval-{suite}")
    support, judged = c.field("citationSupport"), c.field("citationSupport.judgeErrors")
    c.need("suite", _among(c.field("suite"), (suite,)))
    for field in ("health", "citationCoverage", "stats"):
        c.need(field, _record(c.field(field)))
    c.need("citationSupport", _record(support) if suite == "full" else f"{support} IS NULL")
    if suite == "full":
        c.need("citationSupport.judgeErrors", _count(judged))
        c.need("citationSupport.judgeErrors", f"{_number(judged)} = 0", "failed")
        c.need("citationSupport.meanScore", _range(c.field("citationSupport.meanScore"), 0, 2))
    for path in ("citationCoverage.coveragePercent", "citationCoverage.precisionPercent"):
        c.need(path, _range(c.field(path), 0, 100))
    available = c.field("stats.embeddingsAvailable")
    c.need("stats.embeddingsAvailable", f"{available} IS NULL OR {_boolean(available)}")
    c.need("health.score", _range(c.field("health.score"), 0, 100))
    for path, name in (("stats.pageCount", "pages"), ("health.pendingReviews", "reviews"), ("stats.sourceCount", "sources")):
        c.count(path, name)
    violations = c.field("thresholdViolations")
    c.need("thresholdViolations", _list(violations))
    c.counts["violations"] = f"size({_members(violations)})"
    return c


def _search() -> _Contract:
    c = _Contract("search")
    pages, refs = c.field("pages"), c.field("refs")
    c.need("pages", _list(pages))
    c.need("refs", _list(refs))
    c.need("refs:number", f"size({_members(pages)}) = size({_members(refs)})")
    slug, title = _part(_at("x", "slug")), _text(_at("x", "title"), MAX_TITLE)
    c.need("pages", _list_of(pages, "x", " AND ".join((_record("x"), slug, title, _text(_at("x", "summary"), MAX_SUMMARY)))))
    c.need("refs", _list_of(refs, "x", " AND ".join((_record("x"), _among(_at("x", "kind"), REFERENCE_KINDS), _page_id(_at("x", "pageId")), slug, title))))
    ids, slugs = c.strings(refs, "pageId"), c.strings(refs, "slug")
    c.need("refs:slug", f"{c.strings(pages, 'slug')} = {slugs} AND transform({ids}, i -> {_slug_of('i')}) = {slugs}")
    c.need("refs:repeated", _distinct(ids))
    c.warned()
    c.items, c.counts["pages"] = ids, f"size({ids})"
    return c


def _query() -> _Contract:
    c = _Contract("query")
    for field in ("saved", "debug"):
        c.need(field, f"{c.field(field)} IS NULL")
    ids, refs, chosen = (c.field(p) for p in ("pageIds", "refs", "selectedPages"))
    c.need("pageIds", _list_of(ids, "x", _page_id("x")))
    c.need("refs", _list(refs))
    c.need("selectedPages", _list(chosen))
    c.need("refs:number", f"size({_members(refs)}) = size({_members(ids)}) AND size({_members(chosen)}) = size({_members(ids)})")
    c.need("refs", _list_of(refs, "x", " AND ".join((_record("x"), _page_id(_at("x", "pageId")), _part(_at("x", "slug"))))))
    c.need("selectedPages", _list_of(chosen, "x", _part("x")))
    slugs = c.strings(refs, "slug")
    c.need("refs:slug", f"{c.strings(refs, 'pageId')} = {c.strings(ids)} AND {slugs} = {c.strings(chosen)} AND transform({c.strings(ids)}, i -> {_slug_of('i')}) = {slugs}")
    c.need("pageIds:repeated", _distinct(c.strings(ids)))
    answer = c.field("answer")
    c.need("answer", _like(answer, r"[^\s\x{A0}\x{FEFF}\p{Z}]", MAX_ANSWER))
    c.warned()
    c.items, c.counts["pages"] = c.strings(ids), f"size({_members(ids)})"
    return c


def _context() -> _Contract:
    c = _Contract("context")
    c.need("version", _sure(f"{_number(c.field('version'))} = 1"))
    c.warned()
    c.need("warnings", f"NOT array_contains({c.warnings}, 'query-embedding-unavailable')", "provider-unavailable")
    c.need("warnings", f"NOT array_contains({c.warnings}, 'semantic-retrieval-error')", "failed")
    c.need("budget", _record(c.field("budget")))
    primary, gaps = c.field("primary"), c.field("gaps")
    chunks = _list_of(_at("x", "chunks"), "k", f"{_record('k')} AND {_text(_at('k', 'text'), MAX_CONTEXT)}")
    reasons = _list_of(_at("x", "reasons"), "r", _like("r", CODE, 128))
    page = (_record("x"), chunks, reasons, _page_id(_at("x", "id")), f"{_number(_at('x', 'score'))} IS NOT NULL", _text(_at("x", "summary"), MAX_SUMMARY), _text(_at("x", "title"), MAX_TITLE))
    c.need("primary", _list_of(primary, "x", " AND ".join(page), MAX_PRIMARY))
    parts = f"flatten(transform({_members(primary)}, x -> concat(array({_string(_at('x', 'summary'))}), {_strings(_at('x', 'chunks'), 'text')})))"
    c.need("primary:total", f"aggregate({parts}, 0L, (n, t) -> n + coalesce({_units('t')}, 0)) <= {MAX_CONTEXT}")
    c.need("gaps", _list_of(gaps, "x", " AND ".join((_record("x"), _like(_at("x", "code"), CODE, 128), _page_id(_at("x", "pageId"))))))
    for path, name in (("budget.estimatedTokens", "estimated"), ("budget.requestedTokens", "requested")):
        c.count(path, name)
    c.need("budget.truncated", _boolean(c.field("budget.truncated")))
    c.items, c.counts["gaps"] = c.strings(primary, "id"), f"size({_members(gaps)})"
    return c


def _contracts() -> dict[str, _Contract]:
    return {
        "compile": _compile(), "context": _context(), "eval-fast": _evaluation("fast"), "eval-full": _evaluation("full"),
        "lint": _lint(), "query": _query(), "search": _search(), "status": _status(),
    }


def _members_named(text: str, members: dict[str, str]) -> str:
    for name, long in members.items():
        text = text.replace(long, name)
    return text


def normalized_results(results: DataFrame) -> DataFrame:
    """``results`` (result_id, capability, body: JSON text) as result_id, capability, status, detail, outcome, items, counts, warnings.

    ``status``: ``ok``, ``unknown-capability``, ``unreadable`` (no JSON object, or a null body), ``failed`` and
    ``provider-unavailable`` (what the backend itself says went wrong), ``unsafe-item`` (a pending change that isn't a plain file
    name or state), or ``contract``; ``detail`` is then the field, after a colon what it doesn't agree with. Only an accepted result has ``outcome``,
    ``items`` (pages, files or findings' files: sorted where their order says nothing), ``counts`` and ``warnings``. Repeated
    rows are judged each; a list of more than ``MAX_ITEMS`` is refused, never cut.
    """
    rows = results.select("result_id", "capability", F.try_parse_json("body").alias("_body"))
    found, contracts = F.lit(None), _contracts()
    shared = {name: contract.shared() for name, contract in contracts.items()}
    for step in range(3):
        rows = rows.withColumns({column: F.expr(f"if(capability = '{name}', {_members_named(text, steps[1]) if step == 2 else text}, null)") for name, steps in shared.items() for column, text in steps[step].items()})
    for name, contract in contracts.items():
        found = F.when(F.col("capability") == name, contract.told()).otherwise(found)
    readable = F.expr(_record("_body"))
    rows = rows.withColumn("_found", F.when(readable, found))
    known = F.coalesce(F.col("capability").isin(*CAPABILITIES), F.lit(False))
    status = F.when(~known, "unknown-capability").when(~readable, "unreadable").otherwise(F.coalesce("_found.verdict.status", F.lit("ok")))
    rows = rows.withColumn("status", status)
    of = lambda name: F.when(F.col("status") == "ok", F.col(f"_found.said.{name}")).alias(name)
    return rows.select("result_id", "capability", "status", F.col("_found.verdict.detail").alias("detail"), of("outcome"), of("items"), of("counts"), of("warnings"))
