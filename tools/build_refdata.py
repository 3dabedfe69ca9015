"""Builds the packaged reference tables from a folder of public YAML and TSV sources.

    python tools/build_refdata.py SOURCE FORMATS [FALLBACK]

SOURCE holds names/, text/, territories/, langs/ and addresses/ with the tables' sources, and formats.yml
of the address templates in a package's data/addresses folder. Run once; the library only reads the Parquet files that this writes.
"""

from __future__ import annotations

import ast
import csv
import json
import re
import sys
import unicodedata
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import yaml

OUT = Path(__file__).resolve().parent.parent / "lexigrain" / "refdata"
UNSAFE = {"Cc", "Cf", "Cs", "Co", "Cn"}


def clean(value: object) -> str:
    text = unicodedata.normalize("NFC", str(value))
    return "".join(c for c in text if unicodedata.category(c) not in UNSAFE or c in "\t\n\r").strip()


def write(name: str, rows: list[dict]) -> None:
    pq.write_table(pa.Table.from_pylist(rows), OUT / f"{name}.parquet", compression="zstd")
    print(name, len(rows))


class Loader(yaml.SafeLoader):
    """Keeps no, off and the like as text."""


Loader.yaml_implicit_resolvers = {k: [x for x in v if x[0] != "tag:yaml.org,2002:bool"] + ([] if k not in "tTfF" else []) for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}


def load(path: Path):
    return yaml.load(path.read_text("utf-8"), Loader=Loader)


def code(x: object) -> str:
    return str(x).lower().replace("_", "-").strip()


def constants(path: Path, known: dict | None = None) -> dict[str, object]:
    """The text constants and dictionaries of text that a module assigns, read from its syntax tree."""
    found: dict[str, object] = dict(known or {})

    def value(node: ast.expr) -> object:
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Name):
            return found.get(node.id)
        if isinstance(node, ast.Call) and node.args:
            return value(node.args[0])
        if isinstance(node, ast.Dict):
            return {value(k): value(v) for k, v in zip(node.keys, node.values)}
        return None

    for node in ast.parse(path.read_text("utf-8")).body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        for t in targets:
            if isinstance(t, ast.Name) and node.value is not None:
                found[t.id] = value(node.value)
    return found


def code_tables(package: Path) -> None:
    """Tables that exist only as dictionaries in a package's modules."""
    pairs = lambda d: [{"key": k, "value": v} for k, v in d.items() if k and v]
    write("units", pairs(constants(package / "units.py")["UNITS"]))
    types = constants(package / "mime" / "types.py")
    write("mime_labels", [r for r in pairs(types["LABELS"]) if "+" not in r["key"] or r["key"].endswith("opfmessage")])
    write("mime_replace", pairs(constants(package / "mime" / "mappings.py", types)["REPLACE"]))


def fallback(path: Path) -> None:
    """Letters that no transform makes ASCII: pairs ('c', "text") of a source file."""
    pairs = re.findall(r"""\('(\\u\{[0-9A-Fa-f]+\}|[^'])',\s*"((?:[^"\\]|\\.)*)"\)""", path.read_text("utf-8"))
    char = lambda x: chr(int(x[3:-1], 16)) if x.startswith("\\u{") else x
    write("fallback", [{"char": char(a), "ascii": b.replace('\\"', '"')} for a, b in pairs])


def main(source: Path, formats: Path, forms: Path) -> None:
    rows = []
    for path in sorted((source / "territories").glob("*.yml")):
        d = load(path)
        text = lambda k: clean(d[k]) if d.get(k) is not None else None
        flag = lambda k: str(d.get(k)).lower() == "true"
        codes = lambda k: [code(c) for c in d.get(k) or [] if len(code(c)) > 1]
        names = lambda k: sorted({clean(n) for n in d.get(k) or []})
        rows.append(
            {
                "code": code(path.stem), "name": text("name"), "full_name": text("full_name") or text("name"), "alpha3": text("alpha3"), "qid": text("qid"), "other_qids": [str(q) for q in d.get("other_qids") or []],
                "other_codes": codes("other_codes"), "parent": code(d["parent"]) if d.get("parent") else None, "region": text("region"), "subregion": text("subregion"), "in_sentence": text("in_sentence"),
                "is_country": flag("is_country"), "is_ftm": flag("is_ftm"), "is_jurisdiction": flag("is_jurisdiction"), "is_historical": flag("is_historical"),
                "successors": codes("successors"), "claims": codes("claims"), "see": codes("see"), "langs": sorted(set(map(str, d.get("langs") or []))), "names_strong": names("names_strong"), "names_weak": names("names_weak"),
            }
        )
    write("territories", rows)

    specs = load(source / "names" / "org_types.yml")["types"]
    text = lambda s, k: clean(s[k]) if s.get(k) is not None else None
    write("org_types", [{k: text(s, k) for k in ("display", "compare", "generic")} | {"aliases": [clean(a) for a in s["aliases"]]} for s in specs if s.get("aliases")])

    symbols = load(source / "names" / "symbols.yml")
    write("symbols", [{"kind": kind, "id": clean(k), "forms": [clean(v) for v in values or []]} for kind, groups in symbols.items() for k, values in groups.items()])

    words = [{"list": k.lower(), "words": sorted({clean(w) for w in v})} for f in ("names", "text") for k, v in load(source / f / "stopwords.yml").items()]
    write("word_lists", words)
    write("ordinals", [{"number": int(k), "forms": [clean(x) for x in v]} for k, v in load(source / "text" / "ordinals.yml")["ordinals"].items()])
    pairs = load(source / "names" / "compare.yml")["similar_pairs"]
    write("confusable", [{"a": str(a), "b": str(b)} for x, y in pairs for a, b in ((x, y), (y, x))])

    fold = lambda x: str(x).casefold().strip() or None
    ids, two, three = [], {}, {}
    with open(source / "langs" / "iso-639-3.tab", encoding="utf-8") as f:
        for r in csv.DictReader(f, delimiter="\t"):
            iso = fold(r["Id"])
            if not iso or len(iso) != 3:
                continue
            ids.append(iso)
            for k in ("Part1", "Part2B", "Part2T"):
                if v := fold(r[k]):
                    three[v] = iso
                    if k == "Part1":
                        two[iso] = v
            if (name := fold(r["Ref_Name"])) and len(name) > 3:
                three[name] = iso
    for k, values in load(source / "langs" / "names.yaml")["langs"].items():
        if fold(k) in ids:
            three |= {str(v).lower(): fold(k) for v in values}
    write("languages", [{"alpha3": i, "alpha2": two.get(i)} for i in sorted(ids)])
    write("language_names", [{"name": k, "alpha3": v} for k, v in sorted(three.items())])

    write("address_forms", [{"target": clean(k), "forms": [clean(x) for x in v or []]} for k, v in load(forms)["forms"].items()])
    write("address_formats", [{"country": str(k), "spec": json.dumps(v, ensure_ascii=False)} for k, v in load(formats).items() if isinstance(v, dict)])


if __name__ == "__main__":
    if len(sys.argv) > 3:
        fallback(Path(sys.argv[3]))
    code_tables(Path(sys.argv[2]).parents[2])
    main(Path(sys.argv[1]), Path(sys.argv[2]), Path(sys.argv[1]) / "addresses" / "forms.yml")
