"""SAM headers: parsed on the driver, since they are small; sequences keep their order, which is the sort order."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

_REQUIRED = {"HD": ("VN", "SO"), "SQ": ("SN", "LN"), "RG": ("ID",), "PG": ("ID",)}


@dataclass(frozen=True)
class Header:
    hd: dict = field(default_factory=lambda: {"VN": "1.4", "SO": "unknown"})
    sequences: tuple = ()
    read_groups: tuple = ()
    programs: tuple = ()
    comments: tuple = ()

    @property
    def lookup(self) -> dict[str, tuple[int, int]]:
        return {s["SN"]: (i, int(s["LN"])) for i, s in enumerate(self.sequences)}

    @property
    def names(self) -> list[str]:
        return [s["SN"] for s in self.sequences]

    def sorted_by(self, order: str) -> Header:
        return replace(self, hd={**self.hd, "SO": order})

    def with_program(self, name: str, version: str, command: str) -> Header:
        """Append a program record under an id that no other has."""
        taken, k, unique = {p["ID"] for p in self.programs}, 1, name
        while unique in taken:
            k += 1
            unique = f"{name}-{k}"
        return replace(self, programs=(*self.programs, {"ID": unique, "PN": name, "VN": version, "CL": command}))

    def text(self) -> str:
        line = lambda kind, d: "\t".join([f"@{kind}", *(f"{k}:{v}" for k, v in d.items())])
        rows = [line("HD", self.hd), *(line("SQ", d) for d in self.sequences), *(line("RG", d) for d in self.read_groups), *(line("PG", d) for d in self.programs), *(f"@CO\t{c}" for c in self.comments)]
        return "".join(r + "\n" for r in rows)

    def same_dictionary(self, other: Header) -> bool:
        return self.lookup == other.lookup


def parse_header(text: str) -> Header:
    got: dict[str, list] = {k: [] for k in (*_REQUIRED, "CO")}
    for line in text.splitlines():
        kind, _, rest = line[1:].partition("\t")
        if not line.startswith("@") or kind not in got:
            raise ValueError(f"invalid header line {line[:40]}")
        if kind == "CO":
            got[kind].append(rest)
            continue
        d = dict(f.split(":", 1) for f in rest.split("\t") if ":" in f)
        if missing := [k for k in _REQUIRED[kind] if k not in d]:
            raise ValueError(f"@{kind} lacks {', '.join(missing)}")
        got[kind].append(d)
    made = {"sequences": tuple(got["SQ"]), "read_groups": tuple(got["RG"]), "programs": tuple(got["PG"]), "comments": tuple(got["CO"])}
    return Header(hd=got["HD"][0], **made) if got["HD"] else Header(**made)
