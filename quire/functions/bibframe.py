"""MARC to BIBFRAME as triples, and RDF lines: array expressions over the nested record, with no Python and no shuffle.

A record's graph is an array of triples in a fixed order of passes.  A blank node's name tells the pass and the place of
the field that it stands for, so the names do not depend on how rows are spread.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import expr as E
from quire.functions import scalars as S
from quire.schema import TRIPLE

BF, BFLC = "http://id.loc.gov/ontologies/bibframe/", "http://id.loc.gov/ontologies/bflc/"
RDF, RDFS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
RELATORS = "http://id.loc.gov/vocabulary/relators/"
_T = "struct<s string, p string, o string, literal boolean, lang string>"
_TYPE, _LABEL, _VALUE, _ID = f"{RDF}type", f"{RDFS}label", f"{RDF}value", f"{BF}identifiedBy"

WORK_TYPES = {
    "a": "Text", "t": "Text", "c": "NotatedMusic", "d": "NotatedMusic", "e": "Cartography", "f": "Cartography", "g": "MovingImage", "i": "Audio", "j": "MusicAudio",
    "k": "StillImage", "m": "Multimedia", "o": "Kit", "p": "MixedMaterial", "r": "Object",
}
AGENTS = {"00": "Person", "10": "Organization", "11": "Meeting"}
SUBJECTS = {"600": "Person", "610": "Organization", "611": "Meeting", "630": "Work", "650": "Topic", "651": "Place", "655": "GenreForm"}
CLASSIFICATIONS = {"050": "ClassificationLcc", "060": "ClassificationNlm", "080": "ClassificationUdc", "082": "ClassificationDdc", "084": "Classification"}
PROVISIONS = {"0": "Production", "2": "Distribution", "3": "Manufacture"}
#: tag to the relation and whether it holds between instances
LINKING = {
    "760": ("hasSeries", True), "762": ("hasSubseries", True), "765": ("translationOf", False), "767": ("hasTranslation", False), "770": ("supplement", True), "772": ("supplementTo", True), "773": ("partOf", True), "774": ("hasPart", True),
    "775": ("otherEdition", True), "776": ("otherPhysicalFormat", True), "777": ("issuedWith", True), "780": ("precededBy", True), "785": ("succeededBy", True), "786": ("dataSource", False), "787": ("relatedTo", False),
}
_SCRIPTS = {"(3": "ar", "arab": "ar", "(N": "ru", "cyrl": "ru", "hang": "ko", "hani": "zh", "jpan": "ja", "(2": "he", "hebr": "he", "(S": "el", "grek": "el"}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def _lit(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _none() -> Column:
    return F.from_json(F.lit("[]"), f"array<{_T}>")


def _t(s: Column, p: str | Column, o: Column | str, literal: bool = True, lang: Column | None = None) -> Column:
    return F.struct(s.alias("s"), _lit(p).alias("p"), _lit(o).alias("o"), F.lit(literal).alias("literal"), (F.lit(None).cast("string") if lang is None else lang).alias("lang"))


def _one(*args, **kw) -> Column:
    return F.array(_t(*args, **kw))


def _is(node: Column, name: str | Column) -> Column:
    """node is of a class of the vocabulary."""
    return _one(node, _TYPE, F.concat(F.lit(BF), _lit(name)), literal=False)


def _link(s: Column, p: str, node: Column) -> Column:
    return _one(s, p if p.startswith("http") else BF + p, node, literal=False)


def _when(condition: Column, *parts: Column) -> Column:
    return F.when(condition, F.concat(*parts) if len(parts) > 1 else parts[0]).otherwise(_none())


def _maybe(s: Column, p: str, value: Column, lang: Column | None = None) -> Column:
    return _when(value.isNotNull(), _one(s, p if p.startswith("http") else BF + p, value, lang=lang))


def _by_code(f: Column, makes: dict[str, Callable[[Column, Column], Column]]) -> Column:
    """What each subfield with one of the codes gives, in the field's order; makes take the value and its place."""

    def made(s: Column, j: Column) -> Column:
        out = F.when(F.lit(False), _none())
        for code, make in makes.items():
            out = out.when(s["code"] == code, make(s["value"], j))
        return out.otherwise(_none())

    return F.flatten(F.transform(f["subfields"], made))


def _values(s: Column, codes: dict[str, str], lang: Column | None = None) -> dict[str, Callable[[Column, Column], Column]]:
    return {c: (lambda v, _, p=p: _one(s, p if p.startswith("http") else BF + p, v, lang=lang)) for c, p in codes.items()}


def _all_of(f: Column, *codes: str) -> Column:
    return E.values_of(f, *codes)


class _Graph:
    def __init__(self, base_uri: str | None, bflc: bool, use_control_number: bool):
        number = F.coalesce(E.control_value("001"), F.lit("unknown")) if use_control_number else F.lit("unknown")
        self.base, self.number, self.bflc = base_uri, number, bflc
        self.work, self.instance, self.hub = (self.entity(x) for x in ("work", "instance", "hub"))
        self.has_hub = E.first_of("240").isNotNull()

    def entity(self, name: str, suffix: Column | None = None) -> Column:
        if self.base:
            return F.concat(F.lit(f"{self.base}{name}/"), self.number, *([F.lit("-"), suffix] if suffix is not None else []))
        return F.lit(f"_:{name}") if suffix is None else F.concat(F.lit(f"_:{name}"), suffix)

    def each(self, tag: str, make: Callable[[Column, Callable[..., Column]], Column]) -> Column:
        """make(field, node) over the fields of a tag; node(name, place) names a blank node of the field."""

        def one(f: Column, i: Column) -> Column:
            return make(f, lambda name="", j=None: F.concat(F.lit(f"_:f{tag}n"), i.cast("string"), F.lit(name), *([] if j is None else [j.cast("string")])))

        return F.flatten(F.transform(E.fields_of(tag), one))

    # passes

    def entities(self) -> Column:
        kind, level = F.col("leader.record_type"), F.col("leader.bibliographic_level")
        shape = F.when(kind.isin("t", "d", "f"), "Manuscript").when(kind == "m", "Electronic").when(level.isin("s", "i"), "Serial").otherwise("Instance")
        through = [_link(self.work, "hasExpression", self.hub), _link(self.hub, "expressionOf", self.work), _link(self.hub, "hasInstance", self.instance), _link(self.instance, "instanceOf", self.hub)]
        straight = F.concat(_link(self.work, "hasInstance", self.instance), _link(self.instance, "instanceOf", self.work))
        links = F.when(self.has_hub, F.concat(_is(self.hub, "Hub"), *through)).otherwise(straight)
        work_type = F.try_element_at(_map(WORK_TYPES), kind)
        return F.concat(_is(self.work, "Work"), _is(self.instance, shape), links, _when(work_type.isNotNull(), _is(self.work, work_type)))

    def uniform_title(self) -> Column:
        codes = lambda n: {**_values(n, {"a": "mainTitle", "n": "partNumber", "p": "partName"}), **_values(self.hub, {"l": "language", "f": "date", "s": "version"})}
        return self.each("240", lambda f, node: F.concat(_is(node(), "Title"), _by_code(f, codes(node())), _link(self.hub, "title", node())))

    def titles(self) -> Column:
        def one(f: Column, node, main: bool) -> Column:
            parts = [_is(node(), "Title"), _by_code(f, _values(node(), {"a": "mainTitle", "b": "subtitle", "n": "partNumber", "p": "partName"})), _link(self.instance, "title", node())]
            return F.concat(*parts, *([_by_code(f, _values(self.instance, {"c": "responsibilityStatement"}))] if main else []))

        return F.concat(self.each("245", lambda f, n: one(f, n, True)), self.each("246", lambda f, n: one(f, n, False)))

    def contributions(self, century: str) -> Column:
        def one(f: Column, node, agent: str) -> Column:
            kind = F.lit(f"{BFLC}PrimaryContribution" if century == "1" and self.bflc else f"{BF}Contribution")
            names, c, a = _all_of(f, "a", "b", "c", "d", "q"), node("c"), node("a")
            coded = F.size(_all_of(f, "4")) > 0
            role = {"4": lambda v, _: _when(F.trim(v) != "", _one(c, f"{BF}role", F.concat(F.lit(RELATORS), F.lower(F.trim(v))), literal=False)), "e": lambda v, _: _when(~coded, _one(c, f"{BF}role", v))}
            label = _when(F.size(names) > 0, _one(a, _LABEL, F.trim(F.array_join(names, " "))))
            return F.concat(_one(c, _TYPE, kind, literal=False), _is(a, agent), label, _link(c, "agent", a), _by_code(f, role), _link(self.work, "contribution", c))

        return F.concat(*[self.each(century + end, lambda f, n, agent=agent: one(f, n, agent)) for end, agent in AGENTS.items()])

    def subjects(self) -> Column:
        def one(f: Column, node, kind: str) -> Column:
            label = _all_of(f, *"abcdvxyz")
            return F.concat(_is(node(), kind), _when(F.size(label) > 0, _one(node(), _LABEL, F.array_join(label, "--"))), _link(self.work, "subject", node()))

        return F.concat(*[self.each(tag, lambda f, n, kind=kind: one(f, n, kind)) for tag, kind in SUBJECTS.items()])

    def _identifier(self, node: Column, kind: str | Column, value: Column, *more: Column) -> Column:
        return F.concat(_is(node, kind), _one(node, _VALUE, value), *more, _link(self.instance, _ID, node))

    def _bad(self, node, kind: str, name: str, status: str) -> Callable[[Column, Column], Column]:
        return lambda v, j: self._identifier(node(name, j), kind, v, _one(node(name, j), f"{BF}status", F.lit(status)))

    def identifiers(self) -> Column:
        first = E.value_of

        def lccn(f: Column, node) -> Column:
            return F.concat(_is(node(), "Lccn"), _by_code(f, _values(node(), {"a": _VALUE})), _link(self.instance, _ID, node()))

        def isbn(f: Column, node) -> Column:
            good = self._identifier(node(), "Isbn", first(f, "a"), _maybe(node(), "qualifier", first(f, "q")), _maybe(node(), "acquisitionTerms", first(f, "c")))
            return F.concat(_when(first(f, "a").isNotNull(), good), _by_code(f, {"z": self._bad(node, "Isbn", "z", "invalid")}))

        def issn(f: Column, node) -> Column:
            n = node("l")
            kind = _one(n, _TYPE, F.lit(f"{BFLC}IssnL"), literal=False) if self.bflc else F.concat(_is(n, "Issn"), _one(n, f"{BF}note", F.lit("Linking ISSN")))
            linking = F.concat(kind, _one(n, _VALUE, first(f, "l")), _link(self.instance, _ID, n))
            return F.concat(_when(first(f, "a").isNotNull(), self._identifier(node(), "Issn", first(f, "a"))), _when(first(f, "l").isNotNull(), linking), _by_code(f, {"y": self._bad(node, "Issn", "y", "incorrect")}), _by_code(f, {"z": self._bad(node, "Issn", "z", "canceled")}))

        def other(f: Column, node) -> Column:
            named = F.try_element_at(_map({"0": "Isrc", "1": "Upc", "2": "Ismn", "3": "Ean", "4": "Sici"}), f["ind1"])
            said = F.when(f["ind1"] == "7", first(f, "2"))
            named = F.coalesce(named, F.when(said.isin("Isrc", "Upc", "Ismn", "Ean", "Sici"), said))
            parts = [_is(node(), F.coalesce(named, F.lit("Identifier"))), _when(named.isNull() & said.isNotNull(), _one(node(), f"{BF}source", said)), _maybe(node(), _VALUE, first(f, "a")), _maybe(node(), "acquisitionTerms", first(f, "c"))]
            return F.concat(*parts, _by_code(f, _values(node(), {"d": "qualifier"})), _by_code(f, {"z": self._bad(node, "Identifier", "z", "invalid")}), _link(self.instance, _ID, node()))

        def system(f: Column, node) -> Column:
            a = first(f, "a")
            split = a.startswith("(") & a.contains(")")
            number = F.when(split, F.regexp_extract(a, r"(?s)^\([^)]*\)(.*)", 1)).otherwise(a)
            good = self._identifier(node(), "Local", number, _when(split, _one(node(), f"{BF}source", F.regexp_extract(a, r"(?s)^\(([^)]*)\)", 1))))
            return F.concat(_when(a.isNotNull(), good), _by_code(f, {"z": self._bad(node, "Local", "z", "canceled")}))

        return F.concat(*[self.each(tag, make) for tag, make in (("010", lccn), ("020", isbn), ("022", issn), ("024", other), ("035", system))])

    def classification(self) -> Column:
        def one(f: Column, node, kind: str) -> Column:
            parts = [_maybe(node(), p, E.value_of(f, c)) for c, p in (("a", "classificationPortion"), ("b", "itemPortion"), ("2", "source"))]
            return F.concat(_is(node(), kind), *parts, _link(self.work, "classification", node()))

        return F.concat(*[self.each(tag, lambda f, n, kind=kind: one(f, n, kind)) for tag, kind in CLASSIFICATIONS.items()])

    def provision(self) -> Column:
        simple = lambda n, p, v: [_one(n, BFLC + p, v)] if self.bflc else []

        def activity(f: Column, node, kind: Column | str) -> Column:
            n = node()
            place = lambda v, j: F.concat(_is(node("p", j), "Place"), _one(node("p", j), _LABEL, v), _link(n, "place", node("p", j)), *simple(n, "simplePlace", v))
            agent = lambda v, j: F.concat(_one(node("a", j), _LABEL, v), _link(n, "agent", node("a", j)), *simple(n, "simpleAgent", v))
            date = lambda v, _: F.concat(_one(n, f"{BF}date", v), *simple(n, "simpleDate", v))
            return F.concat(_is(n, kind), _by_code(f, {"a": place, "b": agent, "c": date}), _link(self.instance, "provisionActivity", n))

        def of_264(f: Column, node) -> Column:
            kind = F.coalesce(F.try_element_at(_map(PROVISIONS), f["ind2"]), F.lit("Publication"))
            return F.when(f["ind2"] == "4", _by_code(f, _values(self.instance, {"c": "copyrightDate"}))).otherwise(activity(f, node, kind))

        return F.concat(self.each("260", lambda f, n: activity(f, n, "Publication")), self.each("264", of_264))

    def plain(self) -> Column:
        """Physical description and notes."""
        codes = (("300", {"a": "extent", "c": "dimensions"}), ("500", {"a": "note"}), ("520", {"a": "summary"}), ("504", {"a": "note"}))
        return F.concat(*[self.each(tag, lambda f, _, of=of: _by_code(f, _values(self.instance, of))) for tag, of in codes])

    def linked_880(self) -> Column:
        first = E.value_of

        def one(f: Column, node) -> Column:
            six = first(f, "6")
            tag = F.coalesce(F.substring(six, 1, 3), F.lit(""))
            content = S.script_language(F.array_join(F.filter(f["subfields"], lambda s: s["code"] != "6")["value"], ""))
            lang = F.when(six.isNotNull(), F.coalesce(F.try_element_at(_map(_SCRIPTS), F.regexp_extract(six, r"(?s)^[^/]*/(.*)", 1)), content))
            n, a = node(), first(f, "a")
            title = F.concat(_is(n, "Title"), _by_code(f, _values(n, {"a": "mainTitle", "b": "subtitle"}, lang)), _link(self.instance, "title", n))
            simple = _by_code(f, {c: (lambda v, _, p=p: _one(n, BFLC + p, v, lang=lang)) for c, p in (("a", "simplePlace"), ("b", "simpleAgent"), ("c", "simpleDate"))}) if self.bflc else _none()
            words = F.filter(f["subfields"], lambda s: ~s["code"].isin("6", "0", "1"))["value"]
            subject = F.concat(_is(n, "Topic"), _when(F.size(words) > 0, _one(n, _LABEL, F.array_join(words, " "), lang=lang)), _link(self.work, "subject", n))
            own_title = lambda at, value: F.concat(_is(at, "Title"), _one(at, f"{BF}mainTitle", value, lang=lang))
            related = F.concat(_is(n, "Instance"), _when(first(f, "t").isNotNull(), own_title(node("t"), first(f, "t")), _link(n, "title", node("t"))))
            relation = F.concat(F.lit(BF), F.when(tag == "780", "precededBy").when(tag == "785", "succeededBy").otherwise("relatedTo"))
            return (
                F.when(tag.isin("245", "246", "247"), title)
                .when(tag == "250", _maybe(self.instance, "editionStatement", a, lang))
                .when(tag.isin("260", "264"), F.concat(_is(n, "Publication"), simple, _link(self.instance, "provisionActivity", n)))
                .when(tag == "490", _maybe(self.instance, "seriesStatement", a, lang))
                .when(tag.startswith("5"), _maybe(self.instance, "note", a, lang))
                .when(tag.startswith("6"), subject)
                .when(tag == "740", _when(a.isNotNull(), own_title(n, a), _link(self.instance, "title", n)))
                .when(tag.isin("780", "785", "787"), F.concat(related, _one(self.instance, relation, n, literal=False)))
                .otherwise(_none())
            )

        return self.each("880", one)

    def linking(self) -> Column:
        first = E.value_of

        def one(f: Column, node, relation: str, instances: bool) -> Column:
            n = node()
            title = F.concat(_is(node("t"), "Title"), _one(node("t"), f"{BF}mainTitle", first(f, "t")), _link(n, "title", node("t")))
            agent = F.concat(_one(node("a"), _LABEL, first(f, "a")), _link(n, "contribution", node("a")))
            number = lambda at, kind, v: F.concat(_is(at, kind), _one(at, _VALUE, v), _link(n, _ID, at))
            parts = [_when(first(f, "t").isNotNull(), title), _when(first(f, "a").isNotNull(), agent)]
            parts += [_when(first(f, c).isNotNull(), number(node(c), kind, first(f, c))) for c, kind in (("x", "Issn"), ("z", "Isbn"))]
            parts += [_by_code(f, {"w": lambda v, j: number(node("w", j), "Local", v)}), _maybe(n, "note", first(f, "i"))]
            return F.concat(_is(n, "Instance" if instances else "Work"), *parts, _link(self.instance if instances else self.work, relation, n))

        return F.concat(*[self.each(tag, lambda f, n, at=at: one(f, n, *at)) for tag, at in LINKING.items()])

    def series(self) -> Column:
        first = E.value_of

        def stated(f: Column, node) -> Column:
            a, n, x = first(f, "a"), node(), node("x")
            untraced = _when(f["ind1"] != "1", _is(n, "Work"), _one(n, _LABEL, a), _link(self.work, "hasSeries", n))
            issn = F.concat(_is(x, "Issn"), _one(x, _VALUE, first(f, "x")), _link(self.instance, "seriesEnumeration", x))
            return F.concat(_when(a.isNotNull(), _one(self.instance, f"{BF}seriesStatement", a), untraced), _when(first(f, "x").isNotNull(), issn), _maybe(self.instance, "seriesEnumeration", first(f, "v")))

        def added(f: Column, node, agent: str | None) -> Column:
            n, titles = node(), _all_of(f, "a", "t")
            title = F.concat(_is(node("t"), "Title"), _one(node("t"), f"{BF}mainTitle", F.array_join(titles, ". ")), _link(n, "title", node("t")))
            parts = [_is(n, "Work"), _when(F.size(titles) > 0, title)]
            if agent:
                parts += [_is(node("a"), agent), _maybe(node("a"), _LABEL, first(f, "a")), _is(node("c"), "Contribution"), _link(node("c"), "agent", node("a")), _link(n, "contribution", node("c"))]
            return F.concat(*parts, _maybe(self.instance, "seriesEnumeration", first(f, "v")), _link(self.work, "hasSeries", n))

        tags = {f"8{end}": agent for end, agent in AGENTS.items()} | {"830": None}
        return F.concat(self.each("490", stated), *[self.each(tag, lambda f, n, agent=agent: added(f, n, agent)) for tag, agent in tags.items()])

    def formats(self) -> Column:
        first, kind = E.value_of, F.col("leader.record_type")
        single = lambda tag, s, p: self.each(tag, lambda f, _: _maybe(s, p, first(f, "a")))

        def medium(f: Column, node) -> Column:
            return F.concat(_is(node(), "MusicMedium"), _by_code(f, _values(node(), {"a": _LABEL})), _maybe(node(), "count", first(f, "n")), _link(self.work, "musicMedium", node()))

        def scale(f: Column, node) -> Column:
            parts = [_maybe(node(), p, first(f, c)) for c, p in (("a", "scale"), ("b", "projection"), ("c", "coordinates"))]
            return F.concat(_is(node(), "Cartographic"), *parts, _link(self.work, "cartographicAttributes", node()))

        def former(f: Column, node) -> Column:
            return _when(first(f, "a").isNotNull(), _one(node(), _LABEL, first(f, "a")), _maybe(node(), "date", first(f, "b")), _link(self.instance, "frequency", node()))

        return F.concat(
            _when(kind.isin("c", "d", "j"), self.each("382", medium), single("384", self.work, "musicKey"), single("348", self.instance, "musicFormat")),
            _when(kind.isin("e", "f"), self.each("255", scale), single("342", self.instance, "geographicCoverage")),
            _when(F.col("leader.bibliographic_level").isin("s", "i"), single("310", self.instance, "frequency"), self.each("321", former), single("362", self.instance, "firstIssue")),
        )

    def holdings(self) -> Column:
        first = E.value_of

        def item(f: Column, i: Column) -> Column:
            n, p = self.entity("item", i.cast("string")), F.concat(F.lit("_:f852n"), i.cast("string"), F.lit("p"))
            shelf = _all_of(f, *"hijklm")
            code = F.concat(_one(n, f"{BF}itemOf", first(f, "p")), _is(p, "Barcode"), _one(p, _VALUE, first(f, "p")), _link(n, _ID, p))
            return F.concat(
                _is(n, "Item"), _maybe(n, "heldBy", first(f, "a")), _maybe(n, "subLocation", first(f, "b")), _when(F.size(shelf) > 0, _one(n, f"{BF}shelfMark", F.array_join(shelf, " "))), _when(first(f, "p").isNotNull(), code),
                _maybe(n, "note", first(f, "x")), _maybe(n, "note", first(f, "z")), _link(self.instance, "hasItem", n), _link(n, "itemOf", self.instance),
            )

        zero = self.entity("item", F.lit("0"))

        def described(f: Column, node) -> Column:
            number = F.concat(_is(node(), "Local"), _one(node(), _VALUE, first(f, "a")), _link(zero, _ID, node()))
            return F.concat(_when(first(f, "a").isNotNull(), number), *[_maybe(zero, p, first(f, c)) for c, p in (("c", "acquisitionSource"), ("d", "acquisitionDate"), ("j", "status"))])

        new = _when(E.first_of("852").isNull() & E.first_of("876").isNotNull(), _is(zero, "Item"), _link(self.instance, "hasItem", zero))
        return F.concat(F.flatten(F.transform(E.fields_of("852"), item)), new, self.each("876", described))

    def admin(self) -> Column:
        n, level, entered = F.lit("_:admin"), F.col("leader.encoding_level"), E.text_008(0, 6)
        return F.concat(_is(n, "AdminMetadata"), _when(level != " ", _one(n, f"{BFLC}encodingLevel", level)), _maybe(n, "creationDate", entered), _link(self.instance, "adminMetadata", n))

    def passes(self) -> list[Column]:
        out = [self.entities(), self.uniform_title(), self.titles(), self.contributions("1"), self.contributions("7"), self.subjects(), self.identifiers(), self.classification(), self.provision(), self.plain(), self.linked_880(), self.linking(), self.series(), self.formats(), self.holdings()]
        return [*out, self.admin()] if self.bflc else out


def graph(base_uri: str | None = None, bflc: bool = True, use_control_number: bool = True) -> Column:
    """The record's triples in order: array of struct(s, p, o, literal, lang); a name that begins with _: is a blank node."""
    return _graph(SparkContext._active_spark_context, base_uri, bflc, use_control_number)


@lru_cache(maxsize=8)
def _graph(context: SparkContext, base_uri: str | None, bflc: bool, use_control_number: bool) -> Column:
    """Kept for the session, as building so large an expression takes seconds."""
    return F.concat(*_Graph(base_uri, bflc, use_control_number).passes())


def graphs(records: DataFrame, base_uri: str | None = None, bflc: bool = True, use_control_number: bool = True) -> DataFrame:
    """(rec_id, graph): a record's graph as a built column, which later expressions read."""
    return E.once(records.select("rec_id", "leader", "control", "fields"), graph=graph(base_uri, bflc, use_control_number)).select("rec_id", "graph")


def objects_in(graph: Column, p: str, test: Callable[[Column], Column] | None = None) -> Column:
    """A graph's triples with a property, in order."""
    return F.filter(graph, lambda t: (t["p"] == p) if test is None else (t["p"] == p) & test(t))


def nodes_in(graphs_: DataFrame, link: str, make: Callable[[Callable[[str], Column]], list[Column]]) -> DataFrame:
    """One row for each node with triples that a property leads to, within records; make gets of(p): the greatest object of the node."""
    rows = graphs_.select("rec_id", "graph", F.explode(F.array_distinct(objects_in(F.col("graph"), link)["o"])).alias("s"))
    rows = E.once(rows.select("rec_id", "s", "graph"), own=F.filter("graph", lambda t: t["s"] == F.col("s"))).where(F.size("own") > 0)
    return rows.select("rec_id", *make(lambda p: F.array_max(objects_in(F.col("own"), p)["o"])))


def to_bibframe(records: DataFrame, base_uri: str | None = None, bflc: bool = True, use_control_number: bool = True) -> DataFrame:
    """Records as a table of triples (schema TRIPLE): no shuffle; seq is the place in the record's graph."""
    rows = graphs(records, base_uri, bflc, use_control_number).select("rec_id", F.posexplode("graph").alias("seq", "t"))
    kind = lambda c: F.when(c.startswith("_:"), "blank").otherwise("uri")
    made = rows.select("rec_id", "seq", "t.s", kind(F.col("t.s")).alias("s_kind"), "t.p", "t.o", F.when(F.col("t.literal"), "literal").otherwise(kind(F.col("t.o"))).alias("o_kind"), "t.lang", F.lit(None).cast("string").alias("datatype"))
    return made.select(*[x.split()[0] for x in TRIPLE.split(", ")])


# RDF lines ----------------------------------------------------------------------------------------------------


def _escaped(text: Column) -> Column:
    for mark, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def to_ntriples(s: str = "s", p: str = "p", o: str = "o", o_kind: str = "o_kind", lang: str = "lang", datatype: str = "datatype") -> Column:
    """One line of N-Triples (which is Turtle, too) for a row of the triple table."""
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    tail = F.when(F.col(lang).isNotNull(), F.concat(F.lit("@"), F.col(lang))).when(F.col(datatype).isNotNull(), F.concat(F.lit("^^<"), F.col(datatype), F.lit(">"))).otherwise("")
    literal = F.concat(F.lit('"'), _escaped(F.col(o)), F.lit('"'), tail)
    return F.concat(node(s), F.lit(" <"), F.col(p), F.lit("> "), F.when(F.col(o_kind) == "literal", literal).otherwise(node(o)), F.lit(" ."))


_LINE = r'(?s)^\s*(_:\S+|<[^>]*>)\s+<([^>]*)>\s+(_:\S+|<[^>]*>|"(?:[^"\\]|\\.)*")(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?\s*\.\s*$'


#: between the parts of a line that is taken apart; lines that hold it are taken apart part by part
_BETWEEN = "\ue000"


def _line_parts(line: Column) -> Column:
    """The five groups of _LINE, by one match; null where there is none."""
    each = F.when(line.rlike(_LINE), F.array(*[F.regexp_extract(line, _LINE, i) for i in range(1, 6)]))
    at_once = F.split(F.regexp_replace(line, _LINE, _BETWEEN.join(f"${i}" for i in range(1, 6))), _BETWEEN, -1)
    return F.when(line.contains(_BETWEEN), each).otherwise(E.let(at_once, lambda x: F.when(F.size(x) == 5, x)))


def from_ntriples(lines: DataFrame, line: str = "line", keep_unread: bool = False) -> DataFrame:
    """The triples of N-Triples lines, other columns kept; lines that are no triple (blank, comments) give no row, or one of nulls."""
    part = lambda i: F.get("q_parts", F.lit(i - 1))
    bare = lambda c: F.when(c.startswith("<"), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)
    rows = E.once(lines, q_parts=_line_parts(F.col(line)))
    rows = rows if keep_unread else rows.where("q_parts IS NOT NULL")
    rows = rows.withColumns({"q_s": part(1), "p": part(2), "q_o": part(3), "lang": F.nullif(part(4), F.lit("")), "datatype": F.nullif(part(5), F.lit(""))}).drop("q_parts")
    literal = F.col("q_o").startswith('"')
    text = F.substring("q_o", F.lit(2), F.length("q_o") - 2)
    hidden = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    for mark, name in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        hidden = F.replace(hidden, F.lit(name), F.lit(mark))
    kind = lambda c: F.when(c.startswith("_:"), "blank").when(c.isNotNull(), "uri")
    rows = rows.withColumns({"s": bare(F.col("q_s")), "s_kind": kind(F.col("q_s")), "o": F.when(literal, F.replace(hidden, F.lit("\x00"), F.lit("\\"))).otherwise(bare(F.col("q_o"))), "o_kind": F.when(literal, "literal").otherwise(kind(F.col("q_o")))})
    return rows.drop("q_s", "q_o", line)


def find_control_number(triples: DataFrame) -> DataFrame:
    """(rec_id, control_number): the value of the first Lccn or local identifier, by joins within records."""
    nodes = triples.where(F.col("p") == _ID).select("rec_id", F.col("o").alias("s"), F.col("seq").alias("at"))
    found = triples.join(nodes, ["rec_id", "s"]).groupBy("rec_id", "s").agg(F.min("at").alias("at"), F.bool_or((F.col("p") == _TYPE) & F.col("o").rlike("Lccn|Local")).alias("own"), F.max_by("o", F.when((F.col("p") == _VALUE) & (F.col("o_kind") == "literal"), F.col("seq"))).alias("value"))
    return found.where("own AND value IS NOT NULL").groupBy("rec_id").agg(F.min_by("value", "at").alias("control_number"))
