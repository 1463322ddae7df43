"""The schema file of a dataset: fields, format and coordinate system."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

#: Declared types; numbers load as DOUBLE, all else as STRING.
TYPES = ("INTEGER", "DOUBLE", "STRING", "CHAR", "LONG", "NULL")


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[tuple[str, str], ...]
    kind: str = "tab"
    coordinates: str = "default"

    @property
    def one_based(self) -> bool:
        if self.coordinates == "default":
            return self.kind in ("gtf", "vcf")
        return self.coordinates == "1-based"


def loaded_type(declared: str) -> str:
    return "string" if declared.upper() in ("STRING", "CHAR", "BOOL", "BOOLEAN") else "double"


def parse(text: str) -> Schema:
    root = ET.fromstring(text)
    local = lambda e: e.tag.rpartition("}")[2]
    one = next((e for e in root.iter() if any(local(x) == "field" for x in e)), None)
    if one is None:
        raise ValueError("no schema in this file")
    fields = tuple(((f.text or "").strip(), f.get("type", "STRING").upper()) for f in one if local(f) == "field")
    kind = one.get("type", "tab").lower()
    system = one.get("coordinate_system", "default").lower()
    return Schema(root.get("name", ""), fields, kind if kind in ("tab", "gtf", "vcf", "collect") else "tab", system if system in ("0-based", "1-based") else "default")


def render(schema: Schema, collection: str, element: str) -> str:
    """The file's text; the element names are the format's."""
    rows = "\n".join(f"    <field type={quoteattr(t)}>{escape(n)}</field>" for n, t in schema.fields)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<{collection} name={quoteattr(schema.name)}>\n  <{element} type={quoteattr(schema.kind)} coordinate_system={quoteattr(schema.coordinates)}>\n{rows}\n  </{element}>\n</{collection}>\n'
