"""Structured entities by regular rules, with exact spans, priorities and greedy resolution of overlaps; no Python worker runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.arrays import let, runs, scan

PRIORITY = {"high": 0, "medium": 1, "low": 2}


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    priority: str = "low"
    ignore_case: bool = False
    validation: str | None = None
    entity_type: str | None = None

    @property
    def type(self) -> str:
        return self.entity_type or self.name.upper()

    @property
    def flags(self) -> str:
        return "(?iU)" if self.ignore_case else "(?U)"


def rules_of(domain: str, custom: list[Rule] | None = None) -> list[Rule]:
    """The rules of a domain, then own ones (which replace rules of the same name in place), then the general ones not yet named."""
    table: dict[str, Rule] = {n: Rule(n, p, prio, ci, v) for d, n, p, prio, ci, v in fixed.RULES if d == domain and domain != "general"}
    for r in custom or []:
        table[r.name] = r
    for d, n, p, prio, _, _ in fixed.RULES:
        if d == "general" and n not in table:
            table[n] = Rule(n, p, prio)
    ordered = list(table.values())
    return sorted(ordered, key=lambda r: PRIORITY.get(r.priority, 1))


def without_rule(rules: list[Rule], name: str) -> list[Rule]:
    """The rules but the one of that name; the same rules if there is none."""
    return [r for r in rules if r.name != name]


def rule_info(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(name, entity_type, priority, case_insensitive, has_validation) of the rules, in the order in which they are considered."""
    rows = [(i, r.name, r.type, r.priority, r.ignore_case, r.validation is not None) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_ord int, name string, entity_type string, priority string, case_insensitive boolean, has_validation boolean")


def supported_types(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return rule_info(spark, rules).select("entity_type").distinct()


#: Marks put around matches; where a text has such characters itself, others of their kind stand for them during the search.
_OPEN, _SHUT, _OWN = "\ufdd0", "\ufdd1", "\ufdd2\ufdd3"
_SPAN = "struct<start:int,end:int,text:string>"


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, text>> of all matches, half-open in code points; empty for null.

    One search puts marks around the matches, one split finds them; the lengths of what lies between add up to the offsets.
    """
    plain = F.translate(text, _OPEN + _SHUT, _OWN)
    parts = F.split(F.regexp_replace(plain, F.lit(f"{rule.flags}(?:{rule.pattern})"), F.lit(f"{_OPEN}$0{_SHUT}")), _OPEN)

    def place(at: Column, x: Column) -> tuple[Column, Column]:
        hit = F.element_at(F.split(x, _SHUT), 1)
        n = F.char_length(hit)
        # the first part has no mark: it is what lies before the first match
        marked = F.contains(x, F.lit(_SHUT))
        end = F.when(marked, at + n).otherwise(at)
        return (at + F.char_length(x) - marked.cast("int")).cast("int"), F.struct(at.cast("int").alias("start"), end.cast("int").alias("end"), F.when(marked, hit).otherwise("").alias("text"))

    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    placed = F.filter(scan(parts, F.lit(0), _SPAN, place), lambda m: m["end"] > m["start"])
    # a match that held a mark of its own is read from the text itself
    own = F.transform(placed, lambda m: m.withField("text", F.when(m["text"].rlike(f"[{_OWN}]"), F.substring(text, m["start"] + 1, m["end"] - m["start"])).otherwise(m["text"])))
    return F.coalesce(F.when(text.isNotNull(), own), none)


_MATCH = "struct<rule:string,entity_type:string,rule_ord:int,start:int,end:int,text:string,valid:boolean,confidence:double>"


def candidates(text: Column, rules: list[Rule]) -> Column:
    """All matches of all rules in the order in which they are considered, each with its rule."""
    def dressed(r: Rule, i: int):
        def dress(m: Column) -> Column:
            ok = F.lit(True) if r.validation is None else m["text"].rlike(f"^(?:{r.validation})")
            score = F.when(ok, F.lit(1.0)).otherwise(F.lit(0.7)) * F.lit(0.8 if r.priority == "low" else 1.0)
            return F.struct(
                F.lit(r.name).alias("rule"), F.lit(r.type).alias("entity_type"), F.lit(i).alias("rule_ord"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), ok.alias("valid"), score.alias("confidence")
            )

        return dress

    # most texts have no match of most rules: a plain search is far cheaper than placing all of the text
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    each = [F.transform(F.when(text.rlike(r.flags + r.pattern), spans(text, r)).otherwise(none), dressed(r, i)) for i, r in enumerate(rules)]
    return F.concat(*each)


def resolved(all_: Column) -> Column:
    """Greedy choice: a match is kept if it overlaps none kept before; then in order of place.

    Matches are sorted by place and cut into islands that no match reaches out of, so a match is compared with those of its island only.
    """
    fields = ("rule", "entity_type", "rule_ord", "start", "end", "text", "valid", "confidence")
    by_place = F.array_sort(F.transform(all_, lambda x: F.struct(x["start"], x["rule_ord"], x["end"], x.alias("m"))))

    def islands(sorted_: Column) -> Column:
        opens = scan(sorted_, F.lit(-1), "boolean", lambda reach, x: (F.greatest(reach, x["end"]).cast("int"), x["start"] >= reach))
        return runs(sorted_, opens)

    def choose(island: Column) -> Column:
        considered = F.array_sort(F.transform(island, lambda x: F.struct(x["m"]["rule_ord"], x["m"]["start"].alias("start"), x["m"].alias("m"))))
        none = F.expr(f"cast(array() as array<{_MATCH}>)")
        kept = F.aggregate(considered, none, lambda acc, x: F.when(F.exists(acc, lambda y: (y["start"] < x["m"]["end"]) & (x["m"]["start"] < y["end"])), acc).otherwise(F.concat(acc, F.array(x["m"]))))
        back = F.array_sort(F.transform(kept, lambda m: F.struct(m["start"], m["rule_ord"], m.alias("m"))))
        return F.when(F.size(island) == 1, F.transform(island, lambda x: x["m"])).otherwise(F.transform(back, lambda x: x["m"]))

    chosen = let(by_place, lambda s: F.flatten(F.transform(islands(s), choose)))
    return F.transform(chosen, lambda m: F.struct(*(m[f].alias(f) for f in fields)))


def extract(df: DataFrame, rules: list[Rule], key: str, text: str) -> DataFrame:
    """One row for each structured entity of each row: key, rule, entity_type, start, end, text, valid, confidence."""
    found = df.select(F.col(key), F.explode(resolved(candidates(F.col(text), rules))).alias("e"))
    return found.select(key, "e.rule", "e.entity_type", "e.start", "e.end", "e.text", "e.valid", "e.confidence")


def groups(match: Column, rule: Rule, n: int) -> Column:
    """Capture groups group_1..group_n of a match that took part."""
    pairs = F.create_map(*[x for i in range(1, n + 1) for x in (F.lit(f"group_{i}"), F.regexp_extract(match, rule.flags + rule.pattern, i))])
    return F.map_filter(pairs, lambda k, v: v != "")


def valid_entity(text: Column, rule: Rule) -> Column:
    """Whether text as a whole is an entity of the rule."""
    ok = text.rlike(f"{rule.flags}^(?:{rule.pattern})\\z")
    return ok if rule.validation is None else ok & text.rlike(f"^(?:{rule.validation})")


def normalised_entity(domain: Column, kind: Column, text: Column) -> Column:
    """The standard form of an entity's text."""
    t = F.trim(text)
    usc = F.regexp_replace(F.replace(F.replace(t, F.lit("section"), F.lit("§")), F.lit("sec."), F.lit("§")), r"U\.?S\.?C\.?", "U.S.C.")
    return (
        F.when((domain == "medical") & (kind == "DOSAGE"), F.replace(F.replace(t, F.lit("mcg"), F.lit("µg")), F.lit("unit"), F.lit("U")))
        .when((domain == "medical") & (kind == "ROUTE"), F.upper(t))
        .when((domain == "medical") & (kind == "FREQUENCY"), F.replace(F.lower(t), F.lit("."), F.lit("")))
        .when((domain == "legal") & (kind == "USC_CITATION"), usc)
        .when((domain == "legal") & (kind == "CFR_CITATION"), F.regexp_replace(t, r"C\.?F\.?R\.?", "C.F.R."))
        .when((domain == "financial") & (kind == "CURRENCY_AMOUNT"), F.replace(t, F.lit(" "), F.lit("")))
        .when((domain == "financial") & (kind == "TICKER_SYMBOL"), F.upper(t))
        .otherwise(t)
    )
