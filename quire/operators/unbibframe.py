"""BIBFRAME to MARC: a record's triples are gathered once (one shuffle by record) and its small graph is walked in Arrow batches."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.bibframe import BF, LINKING, RDF, RDFS, RELATORS, WORK_TYPES
from quire.functions.mods import _LEADER, MADE
from quire.sources.iso2709 import _arrow, _grouped_control, grouped

_WORKS = (*dict.fromkeys(WORK_TYPES.values()),)
_INSTANCES = ("Serial", "Manuscript", "Electronic", "Print")
#: endings of work types, the longer of two first
_CODES = (("Text", "a"), ("NotatedMusic", "c"), ("Cartography", "e"), ("MovingImage", "g"), ("MusicAudio", "j"), ("Audio", "i"), ("StillImage", "k"), ("Multimedia", "m"), ("Kit", "o"), ("MixedMaterial", "p"), ("Object", "r"))
_SUBJECT_TAGS = {"Person": "600", "Organization": "610", "Meeting": "611", "Work": "630", "Topic": "650", "Place": "651", "GenreForm": "655"}
_ID_TAGS = {"Lccn": "010", "Isbn": "020", "Issn": "022", "Isrc": "024", "Upc": "024", "Ismn": "024", "Ean": "024"}
_PROVISIONS = {"Production": "0", "Publication": "1", "Distribution": "2", "Manufacture": "3"}
_RELATIONS = ("precededBy", "succeededBy", "partOf", "hasPart", "otherPhysicalFormat", "relatedTo", "hasSeries", "supplement", "supplementTo", "otherEdition", "issuedWith")
_TAG_OF = {relation: tag for tag, (relation, _) in LINKING.items()}
_TITLE_ENDS = (("mainTitle", "a"), ("subtitle", "b"), ("partNumber", "n"), ("partName", "p"))

_TYPE, _LABEL, _VALUE = f"{RDF}type", f"{RDFS}label", f"{RDF}value"


def _ending(name: str, table: dict[str, str], default: str) -> str:
    return next((v for k, v in table.items() if name.endswith(k)), default)


class _Walk:
    """One record's graph; triples are (s, p, o, kind of o), in order."""

    def __init__(self, triples: Iterable[tuple[str, str, str, str]]):
        self.of: dict[str, list[tuple[str, str, str]]] = {}
        self.work = self.instance = None
        for s, p, o, kind in triples:
            self.of.setdefault(s, []).append((p, o, kind))
            if p == _TYPE and kind == "uri":
                if self.work is None and (o == f"{BF}Work" or o.endswith(_WORKS)):
                    self.work = s
                if self.instance is None and (o == f"{BF}Instance" or o.endswith(_INSTANCES)):
                    self.instance = s
        self.fields: list[tuple[str, str, str, list[tuple[str, str]]]] = []

    def objects(self, node: str | None, p: str) -> Iterator[str]:
        return (o for q, o, _ in self.of.get(node, ()) if q == p)

    def texts(self, node: str | None, p: str) -> list[str]:
        return [o for q, o, kind in self.of.get(node, ()) if q == p and kind == "literal"]

    def last_type(self, node: str, table: dict[str, str], default: str) -> str:
        types = [o for q, o, kind in self.of.get(node, ()) if q == _TYPE and kind == "uri"]
        return _ending(types[-1], table, default) if types else default

    def add(self, tag: str, indicators: str, subs: list[tuple[str, str]], empty: bool = False) -> None:
        if subs or empty:
            self.fields.append((tag, indicators[0], indicators[1], subs))

    def number(self) -> str | None:
        """The value of the instance's first Lccn or local identifier."""
        for node in self.objects(self.instance, f"{BF}identifiedBy"):
            types, values = list(self.objects(node, _TYPE)), self.texts(node, _VALUE)
            if values and any("Lccn" in t or "Local" in t for t in types):
                return values[-1]
        return None

    def year(self) -> str | None:
        for node in self.objects(self.instance, f"{BF}provisionActivity"):
            for date in self.texts(node, f"{BF}date"):
                digits = "".join(c for c in date if c in "0123456789")[:4]
                if len(digits) == 4:
                    return digits
        return None

    def titles(self) -> None:
        tag = "245"
        for node in self.objects(self.instance, f"{BF}title"):
            if node in self.of:
                self.add(tag, "00", [(code, o) for p, o, kind in self.of[node] if kind == "literal" for end, code in _TITLE_ENDS if p.endswith(end)], empty=True)
                tag = "246"
        for statement in self.texts(self.instance, f"{BF}responsibilityStatement"):
            for f in self.fields[:1]:
                f[3].append(("c", statement))

    def agents(self, century: str) -> None:
        for node in self.objects(self.work, f"{BF}contribution"):
            primary = any("PrimaryContribution" in t for t in self.objects(node, _TYPE))
            agent = next(self.objects(node, f"{BF}agent"), None)
            if node not in self.of or primary != (century == "1") or agent not in self.of:
                continue
            kind = "00"
            for t in self.objects(agent, _TYPE):
                kind = "10" if "Organization" in t else "11" if "Meeting" in t else kind
            subs = [("a", x) for x in self.texts(agent, _LABEL)]
            for p, o, is_a in self.of[node]:
                if p == f"{BF}role" and is_a == "literal":
                    subs.append(("e", o))
                elif p == f"{BF}role" and is_a == "uri" and o.startswith(RELATORS) and o != RELATORS:
                    subs.append(("4", o.removeprefix(RELATORS)))
            self.add(century + kind, "1 ", subs, empty=True)

    def subjects(self) -> None:
        for node in self.objects(self.work, f"{BF}subject"):
            if node in self.of:
                parts = [x.split("--") for x in self.texts(node, _LABEL)]
                subs = [("x" if i else "a", part.strip()) for label in parts for i, part in enumerate(label)]
                self.add(self.last_type(node, _SUBJECT_TAGS, "650"), " 0", subs, empty=True)

    def identifiers(self) -> None:
        for node in self.objects(self.instance, f"{BF}identifiedBy"):
            self.add(self.last_type(node, _ID_TAGS, "035"), "  ", [("a", v) for v in self.texts(node, _VALUE)])

    def provisions(self) -> None:
        for node in self.objects(self.instance, f"{BF}provisionActivity"):
            subs: list[tuple[str, str]] = []
            for p, o, kind in self.of.get(node, ()):
                for code, simple, linked in (("a", "simplePlace", f"{BF}place"), ("b", "simpleAgent", f"{BF}agent")):
                    if p.endswith(simple) and kind == "literal":
                        subs.append((code, o))
                    elif p == linked:
                        subs += [(code, x) for x in self.texts(o, _LABEL)[:1] if all(c != code for c, _ in subs)]
                if kind == "literal" and (p.endswith("simpleDate") or p == f"{BF}date") and all(c != "c" for c, _ in subs):
                    subs.append(("c", o))
            self.add("264", " " + self.last_type(node, _PROVISIONS, "1"), subs)
        for date in self.texts(self.instance, f"{BF}copyrightDate"):
            self.add("264", " 4", [("c", date)])

    def plain(self) -> None:
        """Physical description and notes."""
        mine = [(p, o) for p, o, kind in self.of.get(self.instance, ()) if kind == "literal"]
        codes = {f"{BF}extent": "a", f"{BF}dimensions": "c"}
        self.add("300", "  ", [(codes[p], o) for p, o in mine if p in codes])
        tags = {f"{BF}note": "500", f"{BF}summary": "520"}
        for p, o in mine:
            if p in tags:
                self.add(tags[p], "  ", [("a", o)])

    def series(self) -> None:
        for node in self.objects(self.work, f"{BF}hasSeries"):
            title = ""
            for p, o, kind in self.of.get(node, ()):
                if p.endswith("title"):
                    for q, x, k in self.of.get(o, ()):
                        title = x if q.endswith("mainTitle") and k == "literal" else title
                if p == _LABEL and kind == "literal" and not title:
                    title = o
            self.add("830", " 0", [("a", title)] if title else [])
        stated, counted = (self.texts(self.instance, BF + p)[-1:] for p in ("seriesStatement", "seriesEnumeration"))
        if stated:
            self.add("490", "0 ", [("a", stated[0]), *[("v", x) for x in counted]])

    def linking(self) -> None:
        for relation in _RELATIONS:
            for node in self.objects(self.instance, BF + relation):
                own = self.of.get(node, ())
                subs = [("t", x) for p, o, _ in own if p.endswith("title") for q, x, k in self.of.get(o, ()) if q.endswith("mainTitle") and k == "literal"]
                for number in self.objects(node, f"{BF}identifiedBy"):
                    code = "w"
                    for t in self.objects(number, _TYPE):
                        code = "x" if t.endswith("Issn") else "z" if t.endswith("Isbn") else code
                    subs += [(code, v) for v in self.texts(number, _VALUE)[-1:]]
                self.add(_TAG_OF[relation], "0 ", subs)

    def record(self) -> dict:
        types = [o for q, o, kind in self.of.get(self.work, ()) if q == _TYPE and kind == "uri"]
        levels = [o for q, o, kind in self.of.get(self.instance, ()) if q == _TYPE and kind == "uri"]
        leader = _LEADER | {"record_type": _ending(types[-1], dict(_CODES), "a") if types else "a", "bibliographic_level": "s" if levels and levels[-1].endswith("Serial") else "m"}
        number = self.number() if self.instance else None
        control = [("001", number)] if number is not None else []
        control.append(("008", " " * 6 + "s" + (self.year() or "    ") + "    xx " + " " * 11 + "000 0 eng  "))
        self.titles()
        self.agents("1")
        self.agents("7")
        for part in (self.subjects, self.identifiers, self.provisions, self.plain, self.series, self.linking):
            part()
        return {"leader": leader, "control": _grouped_control(control), "fields": grouped(self.fields), "errors": []}


def _made(graph: Column) -> Column:
    """The record of an array of triples (s, p, o, o_kind)."""
    target = _arrow(MADE)

    @F.arrow_udf(MADE)
    def made(column: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(column), 500):
            some = column.slice(at, 500)
            flat = some.flatten()
            triples = zip(*(flat.field(n).to_pylist() for n in ("s", "p", "o", "o_kind")))  # a dict for each triple would take longer than the walk
            parts.append(pa.array([_Walk(itertools.islice(triples, n)).record() for n in some.value_lengths().to_pylist()], target))
        return pa.concat_arrays(parts) if parts else pa.array([], target)

    return made.asNondeterministic()(graph)


def from_bibframe(triples: DataFrame) -> DataFrame:
    """Triples (schema TRIPLE) as records: rec_id, leader, control, fields, errors."""
    graphs = triples.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("seq", "s", "p", "o", "o_kind"))).alias("g"))
    return graphs.select("rec_id", _made(F.col("g")).alias("r")).select("rec_id", "r.*")


def from_graphs(graphs: DataFrame) -> DataFrame:
    """As from_bibframe, of graphs that still lie whole in one row for each record (bibframe.graphs): no shuffle."""
    kind = lambda t: F.when(t["literal"], "literal").when(t["o"].startswith("_:"), "blank").otherwise("uri")
    rows = graphs.where(F.size("graph") > 0)
    triples = F.transform("graph", lambda t: F.struct(t["s"].alias("s"), t["p"].alias("p"), t["o"].alias("o"), kind(t).alias("o_kind")))
    return rows.select("rec_id", _made(triples).alias("r")).select("rec_id", "r.*")
