"""One rule operator: class rules, tag rules and set rules over whole baskets, one shuffle for all rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Rule:
    """kind: all_of, any_any (one of either list), at_least (distinct names), tag_sum (a name counts for each of its tags), with_least (one of others, and least distinct names of terms), tags_present (least of the terms)."""

    id: str
    kind: str
    terms: tuple = ()
    others: tuple = ()
    least: int = 2
    severity: str = "moderate"
    priority: int = 2
    unless: tuple = field(default=())
    #: Tags that must be there too, whose names are no targets.
    given: tuple = field(default=())
    #: Tags that must not be there.
    without: tuple = field(default=())


def _sql_list(terms) -> str:
    return ", ".join(f"'{t}'" for t in terms)


class Marks:
    """Sets of the tags that rules ask for, as bits of whole numbers, so that a rule is a few operations on numbers however often it is tried."""

    def __init__(self, rules: list[Rule]):
        tags = dict.fromkeys(t for r in rules for t in (*r.terms, *r.others, *r.given, *r.without))
        self.place = {t: divmod(i, 63) for i, t in enumerate(tags)}
        self.words = [f"w{i}" for i in range(-(-len(self.place) // 63))] or ["w0"]

    def _bits(self, terms) -> dict[str, int]:
        out: dict[str, int] = {}
        for t in dict.fromkeys(terms):
            word, bit = self.place[t]
            out[f"w{word}"] = out.get(f"w{word}", 0) | 1 << bit
        return out

    def of(self, tags: Column) -> Column:
        """The set of an array of tags; tags that no rule asks for are left out."""
        none = F.lit(0).cast("long")

        def word(w: str) -> Column:
            bits = F.create_map(*(F.lit(x) for t, (i, bit) in self.place.items() if f"w{i}" == w for x in (t, 1 << bit))).cast("map<string,bigint>")
            return F.aggregate(tags, none, lambda acc, t: acc.bitwiseOR(F.coalesce(bits[t], none)))

        return F.struct(*(word(w).alias(w) for w in self.words))

    def held(self) -> Column:
        """As an aggregate over rows with marks: all their tags."""
        return F.struct(*(F.bit_or(f"marks.{w}").alias(w) for w in self.words))

    def held_by(self, items: Column) -> Column:
        """The same of an array of structs with marks."""

        def word(w: str) -> Column:
            return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x.marks[w]))

        return F.struct(*(word(w).alias(w) for w in self.words))

    def any(self, m: Column, terms) -> Column:
        out = F.lit(False)
        for w, bits in self._bits(terms).items():
            out = out | (m[w].bitwiseAND(F.lit(bits).cast("long")) != 0)
        return out

    def all(self, m: Column, terms) -> Column:
        out = F.lit(True)
        for w, bits in self._bits(terms).items():
            out = out & (m[w].bitwiseAND(F.lit(bits).cast("long")) == bits)
        return out

    def count(self, m: Column, terms) -> Column:
        return sum((F.bit_count(m[w].bitwiseAND(F.lit(bits).cast("long"))) for w, bits in self._bits(terms).items()), F.lit(0))


def fires(rule: Rule, marks: Marks) -> Column:
    """On a basket with columns items (distinct structs of name, shown and marks, by name) and have (the marks of all of them)."""
    have, items = F.col("have"), F.col("items")
    if rule.kind == "all_of":
        return marks.all(have, rule.terms)
    if rule.kind == "any_any":
        return marks.any(have, rule.terms) & marks.any(have, rule.others)
    if rule.kind == "with_least":
        return marks.any(have, rule.others) & fires(Rule("", "at_least", rule.terms, least=rule.least), marks)
    if rule.kind == "tags_present":
        return marks.count(have, rule.terms) >= rule.least
    if rule.kind == "at_least":
        if rule.least == 1:
            return marks.any(have, rule.terms)
        listed = F.transform(F.filter(items, lambda x: marks.any(x.marks, rule.terms)), lambda x: x["name"])
        return (marks.any(have, rule.terms) | F.lit(rule.least <= 0)) & (F.size(F.array_distinct(listed)) >= rule.least)
    return F.aggregate(items, F.lit(0), lambda n, x: n + marks.count(x.marks, rule.terms)) >= rule.least


def targets(rule: Rule, marks: Marks) -> Column:
    """What is shown for the names of the rule's classes, in the order of the names."""
    own = F.filter("items", lambda x: marks.any(x.marks, rule.terms + rule.others))
    return F.transform(F.array_distinct(F.transform(own, lambda x: F.struct(x["name"].alias("name"), x.shown.alias("shown")))), lambda x: x.shown)


def comma_joined(names: Column) -> Column:
    return F.array_join(names, ", ")


def tagged(items: DataFrame, tags: dict[str, tuple], on: str) -> DataFrame:
    table = F.create_map(*(v for k, t in tags.items() for v in (F.lit(k), F.array(*map(F.lit, t)))))
    return items.withColumn("tag", F.explode(table[F.col(on)]))


def gathered(marks: Marks) -> list[Column]:
    """As aggregates over rows with name, shown and marks: items and have, which findings() reads."""
    return [F.array_sort(F.collect_set(F.struct("name", "shown", "marks"))).alias("items"), marks.held().alias("have")]


def findings(rules: list[Rule], marks: Marks, render=comma_joined) -> Column:
    """On a basket with columns as gathered() gives them: an array of priority, place (the rule's), rule_id, severity, targets of the rules that hold and that no other suppresses."""
    by_id = {r.id: r for r in rules}
    found = []
    for i, r in enumerate(rules):
        ok = fires(r, marks)
        for tag in r.given:
            ok = ok & marks.any(F.col("have"), (tag,))
        for tag in r.without:
            ok = ok & ~marks.any(F.col("have"), (tag,))
        for other in r.unless:
            ok = ok & ~fires(by_id[other], marks)
        row = F.struct(F.lit(r.priority).alias("priority"), F.lit(i).alias("place"), F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), render(targets(r, marks)).alias("targets"))
        found.append(F.when(ok, row))
    return F.array_compact(F.array(*found))


def evaluate(items: DataFrame, rules: list[Rule], render=comma_joined) -> DataFrame:
    """items (rx_id, name, tag) -> rx_id, rule_id, severity, priority, targets; rules that others suppress are left out.

    render makes the targets' text of their sorted names. Rows without a name or a tag are in no class; a repeated row counts once.
    """
    items = items.where("name IS NOT NULL AND tag IS NOT NULL")
    marked = items.select("rx_id", "name", F.col("name").alias("shown"), Marks(rules).of(F.array("tag")).alias("marks"))
    return evaluate_marked(marked, rules, render)


def evaluate_marked(items: DataFrame, rules: list[Rule], render=comma_joined) -> DataFrame:
    """The same of items (rx_id, name, shown, marks): marks are the tags of a name as Marks(rules) has them, and render gets what is shown for the names."""
    marks = Marks(rules)
    baskets = items.groupBy("rx_id").agg(*gathered(marks))
    return baskets.select("rx_id", F.explode(findings(rules, marks, render)).alias("f")).select("rx_id", "f.rule_id", "f.severity", "f.priority", "f.targets")


def evaluate_sql(rules: list[Rule], items: str) -> str:
    """The same as SQL over a relation items (rx_id, name, tag)."""
    by_id = {r.id: r for r in rules}

    def test(r: Rule) -> str:
        if r.kind == "all_of":
            return " AND ".join(f"bool_or(tag = '{t}')" for t in r.terms)
        if r.kind == "any_any":
            return f"bool_or(tag IN ({_sql_list(r.terms)})) AND bool_or(tag IN ({_sql_list(r.others)}))"
        if r.kind == "with_least":
            return f"bool_or(tag IN ({_sql_list(r.others)})) AND count(DISTINCT CASE WHEN tag IN ({_sql_list(r.terms)}) THEN name END) >= {r.least}"
        if r.kind == "tags_present":
            return f"count(DISTINCT CASE WHEN tag IN ({_sql_list(r.terms)}) THEN tag END) >= {r.least}"
        if r.kind == "at_least":
            return f"count(DISTINCT CASE WHEN tag IN ({_sql_list(r.terms)}) THEN name END) >= {r.least}"
        return f"count(DISTINCT CASE WHEN tag IN ({_sql_list(r.terms)}) THEN name || '|' || tag END) >= {r.least}"

    parts = []
    for r in rules:
        cond = " AND ".join([f"({test(r)})", *(f"bool_or(tag = '{g}')" for g in r.given), *(f"NOT bool_or(tag = '{g}')" for g in r.without), *(f"NOT ({test(by_id[u])})" for u in r.unless)])
        names = f"array_to_string(list_sort(list_distinct(list(name) FILTER (tag IN ({_sql_list(r.terms + r.others)})))), ', ')"
        parts.append(f"SELECT rx_id, '{r.id}' AS rule_id, '{r.severity}' AS severity, CAST({r.priority} AS INTEGER) AS priority, {names} AS targets FROM {items} GROUP BY rx_id HAVING {cond}")
    return "\nUNION ALL\n".join(parts)
