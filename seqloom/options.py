"""The aligner's options: names, defaults, presets."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Options:
    min_seed: int = 19  # -k
    band: int = 100  # -w
    z_drop: int = 100  # -d
    reseed_factor: float = 1.5  # -r
    third_round_occ: int = 20  # -y
    max_occ: int = 500  # -c
    drop_ratio: float = 0.5  # -D
    min_chain_weight: int = 0  # -W
    max_rescue: int = 50  # -m
    rescue: bool = True  # -S turns it off
    pairing: bool = True  # -P turns it off
    split_width: int = 10  # -s
    chain_gap: int = 10_000  # -G
    max_chain_extend: int = 1 << 30  # -N
    mask_level: float = 0.5  # -X
    match: int = 1  # -A
    mismatch: int = 4  # -B
    open_del: int = 6  # -O
    open_ins: int = 6
    ext_del: int = 1  # -E
    ext_ins: int = 1
    clip5: int = 5  # -L
    clip3: int = 5
    unpaired: int = 17  # -U
    min_score: int = 30  # -T
    xa_most: int = 5  # -h
    xa_most_alt: int = 200
    mapq_coef_len: int = 50  # -Q
    all_hits: bool = False  # -a
    append_comment: bool = False  # -C
    reference_header: bool = False  # -V
    soft_clip: bool = False  # -Y
    supplementary_as_secondary: bool = False  # -M
    primary5: bool = False  # -5
    keep_supplementary_mapq: bool = False  # -q
    interleaved: bool = False  # -p
    fixed_insert: tuple | None = None  # -I mean[,std[,max[,min]]]
    ignore_alt: bool = False  # -j
    chunk_bases: int | None = None  # -K
    threads: int = 1  # -t
    verbosity: int = 3  # -v
    read_group: str | None = None  # -R
    header: str | None = None  # -H
    output: str | None = None  # -o
    fix_mates: bool = False  # -f
    output_format: str = "sam"  # -b: bam, -g: gz
    index_sharing: str = "core"  # -z
    max_insert: int = 10_000
    xa_drop_ratio: float = 0.8
    inputs: tuple = field(default=())

    @property
    def mapq_coef_fac(self) -> int:
        """Cut to an integer, as results depend on."""
        import math

        return int(math.log(self.mapq_coef_len)) if self.mapq_coef_len > 0 else 0

    @property
    def chunk(self) -> int:
        return self.chunk_bases or 10_000_000 * self.threads


#: Presets of -x.
PRESETS = {
    "pacbio": dict(min_seed=17, min_chain_weight=40, min_score=0, match=1, mismatch=1, open_del=1, open_ins=1, ext_del=1, ext_ins=1, reseed_factor=10.0, clip5=0, clip3=0),
    "pbref": dict(min_seed=17, min_chain_weight=40, min_score=0, match=1, mismatch=1, open_del=1, open_ins=1, ext_del=1, ext_ins=1, reseed_factor=10.0, clip5=0, clip3=0),
    "ont2d": dict(min_seed=14, min_chain_weight=20, min_score=0, match=1, mismatch=1, open_del=1, open_ins=1, ext_del=1, ext_ins=1, reseed_factor=10.0, clip5=0, clip3=0),
    "intractg": dict(mismatch=9, open_del=16, open_ins=16, clip5=5, clip3=5),
}
_NUMBERS = {"k": ("min_seed", int), "w": ("band", int), "d": ("z_drop", int), "r": ("reseed_factor", float), "y": ("third_round_occ", int), "c": ("max_occ", int), "D": ("drop_ratio", float), "W": ("min_chain_weight", int), "m": ("max_rescue", int), "s": ("split_width", int), "G": ("chain_gap", int), "N": ("max_chain_extend", int), "X": ("mask_level", float), "A": ("match", int), "B": ("mismatch", int), "U": ("unpaired", int), "T": ("min_score", int), "Q": ("mapq_coef_len", int), "K": ("chunk_bases", int), "t": ("threads", int), "v": ("verbosity", int), "R": ("read_group", str), "H": ("header", str), "o": ("output", str), "z": ("index_sharing", str)}
_PAIRS = {"O": ("open_del", "open_ins"), "E": ("ext_del", "ext_ins"), "L": ("clip5", "clip3"), "h": ("xa_most", "xa_most_alt")}
_SWITCHES = {"a": ("all_hits", True), "C": ("append_comment", True), "V": ("reference_header", True), "Y": ("soft_clip", True), "M": ("supplementary_as_secondary", True), "q": ("keep_supplementary_mapq", True), "p": ("interleaved", True), "S": ("rescue", False), "P": ("pairing", False), "j": ("ignore_alt", True), "f": ("fix_mates", True)}


def unescape(text: str) -> str:
    """Backslash t, n, r and backslash of a command line's text."""
    out, i = [], 0
    known = {"t": "\t", "n": "\n", "r": "\r", "\\": "\\"}
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text) and text[i + 1] in known:
            out.append(known[text[i + 1]])
            i += 2
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def checked_read_group(text: str) -> tuple[str, str]:
    """The line and its ID. It must start with @RG, hold no tab as such, and an ID of at most 255 characters."""
    if not text.startswith("@RG"):
        raise ValueError("a read group starts with @RG")
    if "\t" in text:
        raise ValueError("a read group is written with \\t, not with tabs")
    line = unescape(text)
    ids = [x[3:] for x in line.split("\t")[1:] if x.startswith("ID:")]
    if not ids or not 0 < len(ids[0]) <= 255:
        raise ValueError("a read group has an ID of 1 to 255 characters")
    return line, ids[0]


def parse(command: str | list[str]) -> Options:
    """Options of a command line (without the program's name)."""
    args = shlex.split(command) if isinstance(command, str) else list(command)
    given: dict = {}
    inputs: list[str] = []
    preset = None
    while args:
        a = args.pop(0)
        if not a.startswith("-") or a == "-":
            inputs.append(a)
            continue
        letter, rest = a[1], a[2:]
        if letter in _SWITCHES and not rest:
            name, value = _SWITCHES[letter]
            given[name] = value
        elif letter == "5":
            given |= {"primary5": True, "keep_supplementary_mapq": True}
        elif letter == "b":
            given["output_format"] = "bam"
        elif letter == "g":
            given["output_format"] = "gz"
        elif letter == "1":
            pass
        else:
            value = rest or args.pop(0)
            if letter in _NUMBERS:
                name, kind = _NUMBERS[letter]
                given[name] = kind(value)
            elif letter in _PAIRS:
                parts = [int(x) for x in value.split(",")]
                given |= dict(zip(_PAIRS[letter], parts * 2 if len(parts) == 1 and letter != "h" else parts))
            elif letter == "I":
                given["fixed_insert"] = tuple(float(x) for x in value.split(","))
            elif letter == "x":
                if value not in PRESETS:
                    raise ValueError(f"unknown preset {value}")
                preset = value
            else:
                raise ValueError(f"unknown option -{letter}")
    if given.get("read_group"):
        checked_read_group(given["read_group"])
    if preset:
        given = PRESETS[preset] | given
    elif given.get("match", 1) != 1:
        # what isn't given is scaled with the match score
        a = given["match"]
        for name in ("mismatch", "min_score", "open_del", "open_ins", "ext_del", "ext_ins", "z_drop", "clip5", "clip3", "unpaired"):
            given.setdefault(name, getattr(Options, name) * a)
    return replace(Options(), **given, inputs=tuple(inputs))
