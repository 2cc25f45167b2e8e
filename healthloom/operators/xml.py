"""Clinical XML: validation by rules, refinement, merging and section parsing. One Arrow UDF each; parsing is stdlib only."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HL7 = "urn:hl7-org:v3"
NAMESPACES = {"hl7": HL7, "cda": HL7, "sdtc": "urn:hl7-org:sdtc", "xsi": "http://www.w3.org/2001/XMLSchema-instance", "voc": "http://www.lantanagroup.com/voc"}
SEVERITIES = ("fatal", "errors", "warnings", "information")
ID = "struct<root:string,extension:string>"
RESULT = f"message_valid boolean, fatal array<string>, errors array<string>, warnings array<string>, information array<string>, message_ids struct<eicr:{ID},rr:{ID}>"
ET.register_namespace("", HL7)
ET.register_namespace("sdtc", NAMESPACES["sdtc"])


@dataclass
class Document:
    root: ET.Element
    parents: dict

    def ancestors(self, e: ET.Element) -> list[ET.Element]:
        found = []
        while (e := self.parents.get(e)) is not None:
            found.append(e)
        return found

    def find(self, path: str) -> list[ET.Element]:
        """Elements of a path such as //hl7:A/hl7:b from the root, predicates on attributes included."""
        steps = path.lstrip("/").split("/")
        first = steps[0]
        holder = ET.Element("holder")
        holder.append(self.root)
        return holder.findall((".//" if path.startswith("//") else "./") + "/".join([first, *steps[1:]]), NAMESPACES)


_MARKUP = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>]*>|<(/?)([A-Za-z_][\w:.-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)
_BARE = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)")
_ATTRIBUTE = re.compile(r"([A-Za-z_][\w:.-]*)\s*=\s*(\"[^\"]*\"|'[^']*')")


def mended(text: str) -> str:
    """Broken XML made well-formed: elements left open are closed where their parent ends, end tags that close nothing go,
    bare signs are escaped, and of each attribute the first counts. What stands outside the first root element goes."""
    out, still_open, at = [], [], 0
    plain = lambda x: _BARE.sub("&amp;", x).replace("<", "&lt;")
    for m in _MARKUP.finditer(text):
        if still_open:
            out.append(plain(text[at : m.start()]))
        at = m.end()
        closing, name, rest, empty = m.groups()
        if name is None:
            if still_open and m[0].startswith("<![CDATA["):
                out.append(m[0])
        elif closing:
            if name in still_open:
                while (last := still_open.pop()) != name:
                    out.append(f"</{last}>")
                out.append(f"</{name}>")
                if not still_open:
                    break
        else:
            held = {k: v for k, v in reversed(_ATTRIBUTE.findall(rest))}
            out.append(f"<{name}{''.join(f' {k}={plain(v)}' for k, v in reversed(held.items()))}{empty}>")
            if not empty:
                still_open.append(name)
            elif not still_open:
                break
    else:
        if still_open:
            out.append(plain(text[at:]))
    return "".join(out) + "".join(f"</{x}>" for x in reversed(still_open))


def parsed(text: str | None, mend: bool = False) -> ET.Element | None:
    """The root, or null if it can't be parsed; with mend a broken document is mended first."""
    try:
        return ET.fromstring(text)
    except (TypeError, ValueError):
        return None
    except ET.ParseError:
        if not mend:
            return None
        try:
            return ET.fromstring(mended(text))
        except ET.ParseError:
            return None


def document(text: str | None, mend: bool = False) -> Document | None:
    """The document as parsed, with the parent of each element."""
    root = parsed(text, mend)
    return None if root is None else Document(root, {c: p for p in root.iter() for c in p})


_SPECIAL, _QUOTED = re.compile("[&<>]"), re.compile('[&<>"\r\n\t]')
_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\r": "&#13;", "\n": "&#10;", "\t": "&#09;"}


def written(root: ET.Element) -> str:
    """What ET.tostring(root, encoding="unicode") gives for a parsed document, names and text in one pass."""
    out: list[str] = []
    prefixes: dict[str, str] = {}
    names: dict[str, str] = {}
    escape = lambda m: _ESCAPES[m[0]]

    def name(tag: str) -> str:
        if tag[:1] != "{":
            return tag
        uri, own = tag[1:].rsplit("}", 1)
        if (prefix := prefixes.get(uri)) is None:
            prefix = ET._namespace_map.get(uri)
            prefix = f"ns{len(prefixes)}" if prefix is None else prefix
            if prefix != "xml":
                prefixes[uri] = prefix
        return f"{prefix}:{own}" if prefix else own

    def put(e: ET.Element) -> None:
        if (tag := names.get(e.tag)) is None:
            tag = names[e.tag] = name(e.tag)
        line = f"<{tag}"
        out.append(line)
        for k, v in e.items():
            if (own := names.get(k)) is None:
                own = names[k] = name(k)
            out.append(f' {own}="{_QUOTED.sub(escape, v)}"')
        text = e.text
        if text or len(e):
            out.append(">")
            if text:
                out.append(_SPECIAL.sub(escape, text))
            for c in e:
                put(c)
            out.append(f"</{tag}>")
        else:
            out.append(" />")
        if e.tail:
            out.append(_SPECIAL.sub(escape, e.tail))

    put(root)
    out[0] += "".join(f' xmlns{":" if p else ""}{p}="{_QUOTED.sub(escape, uri)}"' for uri, p in sorted(prefixes.items(), key=lambda x: x[1]))
    return "".join(out)


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _name_of(path: str) -> str:
    return re.split("[/:]", re.sub(r"\[[^]]*\]$", "", path))[-1]


def _fits(e: ET.Element, rule: dict) -> bool:
    """Whether an element is one that a rule is about: its name, and its attributes unless all are to be validated."""
    if _name_of(rule["cdaPath"]).lower() not in local(e.tag).lower():
        return False
    if rule.get("validateAll") == "True":
        return True
    wanted = rule.get("attributes")
    return all(e.get(a["attributeName"]) for a in wanted) if wanted else not e.attrib


def _relative(doc: Document, e: ET.Element, rule: dict, other: dict) -> ET.Element | None:
    """The sibling, ancestor, child or descendant that another path means, if it is as it should be."""
    up = rule["cdaPath"].count("/") - other["cdaPath"].count("/")
    name = _name_of(other["cdaPath"])
    if up > 0:
        above = doc.ancestors(e)
        pool = above[up - 1 : up]
    elif up == 0:
        pool = [x for x in doc.parents.get(e, []) if x is not e]
    else:
        pool = list(e) if up == -1 else [x for x in e.iter() if x is not e]
    for x in pool:
        if name in local(x.tag):
            return x if _fits(x, other) and not attribute_errors(doc, x, other) else None
    return None


def _matches(doc: Document, found: list[ET.Element], rule: dict) -> list[ET.Element]:
    out = []
    for e in found:
        others = rule.get("relatives") or []
        if others and any(_relative(doc, e, rule, o) is None for o in others):
            continue
        if others or _fits(e, rule) or rule.get("textRequired"):
            if rule.get("attributes") and rule.get("validateAll") != "True" and not all(e.get(a["attributeName"]) for a in rule["attributes"]):
                continue
            out.append(e)
    return out


# Messages that users see are fixed values.
def details(rule: dict, value: str | None = None) -> str:
    text = f"Field name: '{rule.get('fieldName')}'"
    if value:
        text += f" value: '{value}'"
    if rule.get("attributes"):
        text += " Attributes: " + ", ".join(f"attribute #{i}: '{a['attributeName']}'" + (f" with the required value pattern: '{a['regEx']}'" if a.get("regEx") else "") for i, a in enumerate(rule["attributes"], 1))
    if rule.get("relatives"):
        text += " Related elements: " + ", ".join(f"'{r.get('name')}'" for r in rule["relatives"])
    return text


def attribute_errors(doc: Document, e: ET.Element, rule: dict) -> list[str]:
    found = []
    for a in rule.get("attributes") or []:
        name, value = a["attributeName"], e.get(a["attributeName"])
        if not value:
            found.append(rule.get("customMessage") or f"Could not find attribute {name}. {details(rule)}")
        elif a.get("regEx") and not re.match(a["regEx"], value):
            found.append(rule.get("customMessage") or f"Attribute: '{name}' not in expected format. {details(rule, value)}")
    return found


def value_errors(e: ET.Element, rule: dict) -> list[str]:
    text, pattern = (e.text or "").strip(), rule.get("regEx")
    if not rule.get("textRequired") and not pattern:
        return []
    if not text:
        return [rule.get("customMessage") or f"Field does not have a value. {details(rule)}"]
    if pattern and not re.match(pattern, text):
        return [rule.get("customMessage") or f"Field does not match regEx: {pattern}. {details(rule, text)}"]
    return []


def message_ids(doc: Document) -> dict:
    """Ids of the case report, and of the response that it may hold."""
    take = lambda e: None if e is None else {"root": e.get("root"), "extension": e.get("extension")}
    own = doc.root.find("hl7:id", NAMESPACES)
    response = doc.root.find(".//hl7:section/hl7:code[@code='88085-6']/../hl7:id", NAMESPACES)
    return {"eicr": take(own), "rr": take(response)}


def validate_one(text: str | None, rules: list[dict], include: tuple[str, ...] = SEVERITIES) -> dict:
    messages: dict[str, list[str]] = {s: [] for s in SEVERITIES}
    doc = document(text, mend=True)
    ids = {"eicr": None, "rr": None}
    if doc is None:
        messages["fatal"].append("eCR Message is not valid XML!")
    else:
        ids = message_ids(doc)
        for rule in rules:
            kind = rule.get("errorType") if rule.get("errorType") in SEVERITIES else "errors"
            found = _matches(doc, doc.find(rule["cdaPath"]), rule)
            if not found:
                messages[kind].append(f"Could not find field. {details(rule)}")
                continue
            attributes = [m for e in found for m in attribute_errors(doc, e, rule)]
            texts = [m for e in found for m in value_errors(e, rule)]
            if not (rule.get("validateOne") and len(attributes) < len(found) and len(texts) < len(found)):
                messages[kind] += attributes + texts
    valid = not messages["fatal"]
    if valid:
        messages["information"].append("Validation completed with no fatal errors!")
    # Fatal errors are told whatever is asked for.
    return {"message_valid": valid, **{s: messages[s] if s in include or s == "fatal" else [] for s in SEVERITIES}, "message_ids": ids}


def validate(ecr: Column, rules: list[dict], include: tuple[str, ...] = SEVERITIES) -> Column:
    @F.pandas_udf(RESULT)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([validate_one(x, rules, include) for x in s], columns=["message_valid", *SEVERITIES, "message_ids"])

    return run(ecr)


def validate_other(kind: str) -> Column:
    """ELR, VXU and FHIR messages aren't checked: valid, with a note."""
    none = F.array().cast("array<string>")
    return F.struct(F.lit(True).alias("message_valid"), none.alias("fatal"), none.alias("errors"), none.alias("warnings"), F.array(F.lit(f"No validation was actually performed. Validation for {kind} messages is only stubbed currently.")).alias("information"))


def roll_up(results: DataFrame, result: str = "result") -> DataFrame:
    """severity, n: messages of a batch of results."""

    def told(severity: str):
        return lambda m: F.struct(F.lit(severity).alias("severity"), m.alias("message"))

    both = F.flatten(F.array(*[F.transform(F.col(f"{result}.{s}"), told(s)) for s in SEVERITIES]))
    return results.select(F.explode(both).alias("e")).groupBy("e.severity").agg(F.count("*").alias("n"))


# Names with their namespace in place: found without a table of prefixes.
_CODE, _TEXT, _ENTRY, _COMPONENT, _TEMPLATE = (f"{{{HL7}}}{x}" for x in ("code", "text", "entry", "component", "templateId"))
_SECTION_CODE, _BODY = f"{{{HL7}}}section/{_CODE}", f".//{{{HL7}}}structuredBody"


def find_section(body: ET.Element, code: str) -> ET.Element | None:
    found = [s for s in body.iter(f"{{{HL7}}}section") if (c := s.find(_CODE)) is not None and c.get("code") == code]
    return found[0] if len(found) == 1 else None


def observations(section: ET.Element, templates: set[str], codes: set[str]) -> list[ET.Element]:
    """Observations of a section with one of the template roots or codes, each once."""
    out = []
    for o in section.iter(f"{{{HL7}}}observation"):
        roots = {t.get("root") for t in o.findall(_TEMPLATE)}
        coded = {c.get("code") for c in o.iter() if local(c.tag) in ("code", "value", "translation")}
        if roots & templates or coded & codes:
            out.append(o)
    return out


def observation_row(o: ET.Element, templates: set[str]) -> dict:
    c = o.find(_CODE)
    get = lambda k: None if c is None else c.get(k)
    return {"display": get("displayName"), "code": get("code"), "code_system": get("codeSystemName"), "is_trigger": bool({t.get("root") for t in o.findall(_TEMPLATE)} & templates)}


def _text_of(rows: list[dict] | None, title: str) -> ET.Element:
    text = ET.Element(f"{{{HL7}}}text")
    ET.SubElement(text, f"{{{HL7}}}title").text = title
    table = ET.SubElement(text, f"{{{HL7}}}table", border="1")
    lines = [["Section details have been removed as requested"]] if rows is None else [["Display Text", "Code", "Code System", "Trigger Code Observation"], *[[r["display"], r["code"], r["code_system"], "TRUE" if r["is_trigger"] else "FALSE"] for r in rows]]
    for n, line in enumerate(lines):
        tr = ET.SubElement(table, f"{{{HL7}}}tr")
        for cell in line:
            ET.SubElement(tr, f"{{{HL7}}}{'th' if n == 0 and rows is not None else 'td'}").text = cell
    return text


def _put_text(section: ET.Element, text: ET.Element) -> None:
    old = section.find(_TEXT)
    at = list(section).index(old) if old is not None else 0
    if old is not None:
        section.remove(old)
    section.insert(at, text)


def refine_one(xml: str | None, sections: dict[str, set[str]], include: list[str] | None = None, services: set[str] | None = None, title: str = "Refined section") -> str | None:
    """The report with its known sections (code to trigger templates) reduced to matching observations, or emptied.

    ``include`` alone leaves those sections as they are; ``services`` alone also keeps observations of those codes in all
    sections; both together look for the codes in ``include`` only. Sections that aren't known are removed.
    """
    root = parsed(xml)
    if root is None:
        return None
    body = root.find(_BODY)
    if body is None:
        return written(root)
    for code, templates in sections.items():
        if include is not None and services is None and code in include:
            continue
        section = find_section(body, code)
        if section is None:
            continue
        codes = services if services is not None and (include is None or code in include) else set()
        kept = observations(section, templates, codes or set())
        parents = {c: p for p in section.iter() for c in p}
        if not kept:
            for e in section.findall(_ENTRY):
                section.remove(e)
            _put_text(section, _text_of(None, title))
            section.set("nullFlavor", "NI")
            continue
        paths = set()
        for o in kept:
            while o is not section:
                paths.add(o)
                o = parents[o]
        for e in section.findall(_ENTRY):
            if e not in paths:
                section.remove(e)
                continue
            for other in [x for x in e.iter(f"{{{HL7}}}observation") if x not in paths and not any(y in kept for y in _above(x, parents))]:
                holder = parents[other]
                if holder in paths and other in list(holder):
                    holder.remove(other)
        _put_text(section, _text_of([observation_row(o, templates) for o in kept], title))
    for c in body.findall(_COMPONENT):
        s = c.find(_SECTION_CODE)
        if s is None or s.get("code") not in sections:
            body.remove(c)
    return written(root)


def _above(e: ET.Element, parents: dict) -> list[ET.Element]:
    out = []
    while (e := parents.get(e)) is not None:
        out.append(e)
    return out


def refine(ecr: Column, sections: dict[str, set[str]], include: list[str] | None = None, services: set[str] | None = None) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: refine_one(x, sections, include, services))

    return run(ecr)


def observation_table(ecr: Column, templates: set[str]) -> Column:
    """All observations as an array of structs, for relational use."""

    @F.pandas_udf("array<struct<section:string,display:string,code:string,code_system:string,is_trigger:boolean>>")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            doc = document(x)
            if doc is None:
                return []
            out = []
            for section in doc.root.iter(f"{{{HL7}}}section"):
                c = section.find("hl7:code", NAMESPACES)
                out += [{"section": None if c is None else c.get("code"), **observation_row(o, templates)} for e in section.findall("hl7:entry", NAMESPACES) for o in e.iter(f"{{{HL7}}}observation")]
            return out

        return s.map(one)

    return run(ecr)


# What a case report takes from a response's root, the template of the section of its status and of the status itself.
RESPONSE_PARTS = ("templateId", "id", "code", "title", "effectiveTime", "confidentialityCode")
STATUS_SECTION, STATUS_ACT = "2.16.840.1.113883.10.20.15.2.2.3", "2.16.840.1.113883.10.20.15.2.3.29"
RESPONSE_CODE = "88085-6"


_SECTIONS = "/".join(f"{{{HL7}}}{x}" for x in ("component", "structuredBody", "component", "section"))


def _response_sections(response: ET.Element) -> list[ET.Element]:
    return response.findall(_SECTIONS)


def _decisive_entry(sections: list[ET.Element]) -> ET.Element | None:
    """The entry derived from the case: an event cluster. Of several the last counts."""
    found = None
    for entry in (e for s in sections for e in s.findall(_ENTRY) if "DRIV" in e.get("typeCode", "")):
        organizer = entry.find(f"{{{HL7}}}organizer")
        if organizer is not None and "CLUSTER" in organizer.get("classCode", "") and "EVN" in organizer.get("moodCode", ""):
            found = entry
    return found


def _status_entry(sections: list[ET.Element]) -> ET.Element | None:
    """The entry that tells the response's processing status; of several the last counts."""

    def templated(e: ET.Element, wanted: str) -> bool:
        template = e.find(_TEMPLATE)
        return template is not None and wanted in template.get("root", "")

    entries = [e for s in sections if templated(s, STATUS_SECTION) for e in s.findall(_ENTRY)]
    return next((e for e in reversed(entries) if any(templated(a, STATUS_ACT) for a in e.findall(f"{{{HL7}}}act"))), None)


def merge_response_one(rr: str | None, ecr: str | None) -> str | None:
    """The case report with a section made of its response, at the end of the root: the parts of the response's root, its
    status entry and its decisive entry. A report that has the response's code anywhere stays, as it does where the response has
    no decisive entry or either is no XML; null stays null."""
    report, response = parsed(ecr), parsed(rr)
    if report is None or response is None or any(e.get("code") == RESPONSE_CODE for e in report.iter()):
        return ecr
    sections = _response_sections(response)
    entry = _decisive_entry(sections)
    if entry is None:
        return ecr
    parts = [response.find(f"{{{HL7}}}{tag}") for tag in RESPONSE_PARTS] + [_status_entry(sections), entry]
    section = ET.SubElement(report, f"{{{HL7}}}section")
    section.extend([p for p in parts if p is not None])
    return written(report)


@F.pandas_udf(StringType())
def merge_response(rr: pd.Series, ecr: pd.Series) -> pd.Series:
    return pd.Series([merge_response_one(x, y) for x, y in zip(rr, ecr, strict=True)])


def resolve_references_one(xml: str | None) -> str | None:
    """The document with the text behind each <reference value="#id"/> put in its place."""
    doc = document(xml)
    if doc is None:
        return xml
    by_id = {e.get("ID"): "".join(e.itertext()).strip() for e in doc.root.iter() if e.get("ID")}
    for e in list(doc.root.iter()):
        if local(e.tag) == "reference" and (v := e.get("value") or "").startswith("#") and v[1:] in by_id:
            parent = doc.parents[e]
            parent.text = by_id[v[1:]]
            parent.remove(e)
    return ET.tostring(doc.root, encoding="unicode")


@F.pandas_udf(StringType())
def resolve_references(s: pd.Series) -> pd.Series:
    return s.map(resolve_references_one)


def conversion_settings(message: Column) -> Column:
    """struct<input_type, root_template>: hl7v2 by its structure, clinical documents by their document code."""
    from ..functions import hl7

    # Document codes and their templates.
    templates = F.create_map(*[F.lit(x) for p in (("34133-9", "CCD"), ("11488-4", "ConsultationNote"), ("18842-5", "DischargeSummary"), ("34117-2", "HistoryandPhysical"), ("11504-8", "OperativeNote"), ("28570-0", "ProcedureNote"), ("11506-3", "ProgressNote"), ("57133-1", "ReferralNote"), ("18761-7", "TransferSummary"), ("55751-2", "EICR")) for x in p])
    code = F.regexp_extract(message, r'<code[^>]*code="([^"]+)"', 1)
    return F.when(hl7.message_kind(message) == "hl7v2", F.struct(F.lit("hl7v2").alias("input_type"), hl7.message_structure(message).alias("root_template"))).otherwise(F.struct(F.lit("ccda").alias("input_type"), F.coalesce(F.try_element_at(templates, code), F.lit("CCD")).alias("root_template")))
