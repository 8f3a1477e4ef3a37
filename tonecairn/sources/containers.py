"""Programs of the newer sampler container: nested items, a preset dictionary of tagged chunks, a file list, groups and zones.

Records are described by layouts (name and ``struct`` code of each field) and read from them. Everything raises ``NotReadable``
where the bytes are not what the layouts say, so a file that is cut short takes no other with it.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable, Iterator

from .mappings import fastlz
from .programs import ITEM_CONTAINER, NotReadable

# Kinds of an item's parts, the application that wrote it, kinds of preset chunks, the newest known layout.
END, APPLICATION, PRESET, SUB_TREE, SAMPLER = 1, 101, 109, 115, 2
BANK, GROUP, PROGRAM, PROGRAM_BOX, GROUPS, ZONES, LOOPS, FILES, FILES_EX = 0x03, 0x04, 0x28, 0x29, 0x33, 0x34, 0x39, 0x3D, 0x4B
NEWEST = 0x9C
LOOP_MODES, LOOP_RECORD, NO_FILE = (1, 2), 0x60, 0x80000000
# Segments of a file's path: a drive of two letters, a named one, a folder, one up, a name, nothing.
DRIVE, VOLUME, FOLDER, UP, NAMES, NOTHING = 0, 1, 2, 3, (4, 8, 9), 6
# The records; a field without a name is passed over, s is a counted UTF-16 text.
ITEM = "version:I magic:4s :24x"
PART = ":I kind:I version:I"
DICTIONARY = ":8x entries:I size:I :4x"
STRUCTURE = "version:H"
LOOP = "layout:H mode:i start:I length:I :9x fade:I"
ZONE = "start:I cut:I :4x vel_low:H vel_high:H key_low:H key_high:H :8x root:H volume:f pan:f tune:f"
ZONE_FILE, ZONE_EXTRA = "file:I :9x frames:I", 6
GROUP_RECORD = "name:s volume:f pan:f tune:f track:B reverse:B on_release:B :15x muted:B soloed:B"
PROGRAM_RECORD = "name:s :9x volume:f pan:f tune:f :22x solo:B"


def fields(layout: str, data: bytes, at: int = 0) -> tuple[dict, int]:
    """A record at a place, and the place after it."""
    out = {}
    for field in layout.split():
        name, code = field.split(":")
        code, size = "<" + code, 0
        try:
            if code == "<s":
                size = 2 * struct.unpack_from("<I", data, at)[0]
                if at + 4 + size > len(data):
                    raise NotReadable("a text past the end")
                out[name] = data[at + 4 : at + 4 + size].decode("utf-16-le", "replace")
                at += 4 + size
                continue
            found = struct.unpack_from(code, data, at)
        except struct.error:
            raise NotReadable("cut short") from None
        if name:
            out[name] = found[0]
        at += struct.calcsize(code)
    return out, at


def counted(data: bytes, at: int, code: str = "<I", itself: int = 0) -> tuple[bytes, int]:
    """Bytes after their number, which counts ``itself`` bytes of its own; and the place after them."""
    try:
        size = struct.unpack_from(code, data, at)[0] - itself
    except struct.error:
        raise NotReadable("cut short") from None
    at += struct.calcsize(code)
    if size < 0 or at + size > len(data):
        raise NotReadable("a block past the end")
    return data[at : at + size], at + size


def parts(block: bytes) -> Iterator[tuple[int, bytes]]:
    """(kind, own bytes) of an item's parts, the outermost first: each is wrapped around those after it."""
    head, at = fields(PART, block)
    if head["version"] != 1:
        raise NotReadable("an unknown part")
    inner = None
    if head["kind"] != END:
        inner, at = counted(block, at, "<Q", 8)
    yield head["kind"], block[at:]
    if inner is not None:
        yield from parts(inner)


def walk(data: bytes, at: int = 0) -> Iterator[tuple[int, bytes | None]]:
    """(kind, bytes) of all parts of an item and of the items in it, in depth; None for a sub-tree that can't be decoded."""
    body, _ = counted(data, at, "<Q", 8)
    head, at = fields(ITEM, body)
    if head["version"] != 1 or head["magic"] != ITEM_CONTAINER:
        raise NotReadable("no item")
    block, at = counted(body, at, "<Q", 8)
    for kind, own in parts(block):
        yield kind, own
        if kind == SUB_TREE:
            tree, at_tree = fields("version:I packed:B", own)
            if tree["version"] != 1:
                raise NotReadable("an unknown sub-tree")
            if not tree["packed"]:
                yield from walk(own, at_tree)
                continue
            sizes, at_tree = fields("whole:I packed:I", own, at_tree)
            try:
                whole = fastlz(own[at_tree : at_tree + sizes["packed"]], sizes["whole"])
            except ValueError:
                yield SUB_TREE, None
                continue
            yield from walk(whole)
    children, at = fields(":4x n:I", body, at)
    for _ in range(children["n"]):
        child, _ = counted(body, at + 12, "<Q", 8)
        yield from walk(body, at + 12)
        at += 20 + len(child)


def structured(data: bytes, at: int, kind: int) -> tuple[dict, int]:
    """A chunk with version, public bytes and chunks in it; a plain one has the rest of the bytes."""
    plain, at = fields("held:B", data, at)
    if not plain["held"]:
        return {"kind": kind, "version": -1, "public": data[at:], "inner": []}, len(data)
    head, at = fields(STRUCTURE, data, at)
    _, at = counted(data, at)
    public, at = counted(data, at)
    inner, at = counted(data, at)
    return {"kind": kind, "version": head["version"], "public": public, "inner": list(chunks(inner))}, at


def chunks(data: bytes) -> Iterator[dict]:
    at = 0
    while at < len(data):
        head, at = fields("kind:H", data, at)
        own, at = counted(data, at)
        kind = head["kind"]
        if kind in (GROUPS, ZONES):
            number, place = fields("n:I", own)
            listed = []
            for _ in range(number["n"]):
                of = {"of": GROUP}
                if kind == ZONES:
                    of, place = fields("of:I", own, place)
                one, place = structured(own, place, of["of"])
                listed.append(one)
            yield {"kind": kind, "version": -1, "public": b"", "inner": listed}
        elif kind in (BANK, PROGRAM_BOX, PROGRAM):
            yield structured(own, 0, kind)[0]
        else:
            yield {"kind": kind, "version": -1, "public": own, "inner": []}


def found(tree: list[dict], kind: int) -> Iterator[dict]:
    """The outermost chunks of a kind."""
    for c in tree:
        if c["kind"] == kind:
            yield c
        else:
            yield from found(c["inner"], kind)


def file_path(data: bytes, at: int) -> tuple[str, int]:
    number, at = fields("n:I", data, at)
    out = []
    for _ in range(number["n"]):
        segment, at = fields("kind:B", data, at)
        kind, text = segment["kind"], {"text": ""}
        if kind == DRIVE:
            text, at = fields("text:2s", data, at)
            text = {"text": text["text"].decode("ascii", "replace").strip()}
        elif kind in (VOLUME, FOLDER, *NAMES):
            text, at = fields("text:s", data, at)
        elif kind not in (UP, NOTHING):
            raise NotReadable(f"path segment {kind}")
        name = text["text"]
        out.append({UP: "../", FOLDER: name + "/"}.get(kind, (f"{name}:/" if name else "/") if kind in (DRIVE, VOLUME) else name))
    return "".join(out), at


def file_list(chunk: dict) -> list[str]:
    """Paths by number. The older layouts begin with a list of special files; the newest has one fewer than it says, each with book-keeping after it."""
    data, at, version = chunk["public"], 0, 0
    if chunk["kind"] == FILES_EX:
        head, at = fields("version:H", data, at)
        version = head["version"]
        if version not in (2, 3):
            raise NotReadable(f"file list {version}")
    paths: list[str] = []
    for lists in range(1 if version == 3 else 2):
        paths = []
        if at >= len(data):
            continue
        number, at = fields("n:i :8x" if version == 3 else "n:i", data, at)
        for _ in range(number["n"] - (version == 3)):
            path, at = file_path(data, at)
            paths.append(path)
            if version == 3 and at < len(data):
                _, at = fields(":28x", data, at)
    return paths


def loops(data: bytes) -> list[dict]:
    if len(data) < 2:
        return []
    bits, at = fields("on:H", data)
    out = []
    for _ in range((bits["on"] & 255).bit_count()):
        loop, at = fields(LOOP, data, at)
        if loop["layout"] != LOOP_RECORD:
            raise NotReadable("an unknown loop")
        at += at < len(data)
        out.append(loop)
    return out


def _record(chunk: dict, layout: str) -> dict:
    if chunk["version"] > NEWEST:
        raise NotReadable(f"layout {chunk['version']:#x}")
    return fields(layout, chunk["public"])[0]


def _zone_record(chunk: dict) -> dict | None:
    """None for a zone without a sample."""
    zone, at = _record(chunk, ZONE), fields(ZONE, chunk["public"])[1]
    if chunk["version"] >= 0x9A:
        _, at = fields(f":{ZONE_EXTRA}x", chunk["public"], at)
        if at == len(chunk["public"]):
            return None
    file = fields(ZONE_FILE, chunk["public"], at)[0]
    loop = next((x for c in chunk["inner"] if c["kind"] == LOOPS for x in loops(c["public"]) if x["mode"] in LOOP_MODES), None)
    return None if file["file"] >= NO_FILE else {**zone, **file, "group": chunk["kind"], "loop": loop}


def programs(raw: bytes) -> list[dict]:
    """name, volume, pan, tune, solo, groups, zones and files of every program."""
    seen = list(walk(raw))
    for own in (own for kind, own in seen if kind == APPLICATION):
        if fields(":5x id:I", own)[0]["id"] != SAMPLER:
            raise NotReadable("another application's file")
        break
    preset = next((own for kind, own in seen if kind == PRESET), None)
    if preset is None:
        raise NotReadable("a protected program" if (SUB_TREE, None) in seen else "no preset")
    head, at = fields(DICTIONARY, preset)
    if head["entries"] != 1 or at + head["size"] > len(preset):
        raise NotReadable("an unknown dictionary")
    tree = list(chunks(preset[at : at + head["size"]]))
    lists = [c for c in tree if c["kind"] in (FILES, FILES_EX)]
    files, out = file_list(lists[0]) if lists else [], []
    for c in found(tree, PROGRAM):
        inner = lambda kind, c=c: [x for box in c["inner"] if box["kind"] == kind for x in box["inner"]]
        zones = [z for z in map(_zone_record, inner(ZONES)) if z]
        out.append({**fields(PROGRAM_RECORD, c["public"])[0], "groups": [_record(g, GROUP_RECORD) for g in inner(GROUPS)], "zones": zones, "files": files})
    if not out:
        raise NotReadable("no program")
    return out


_ABSOLUTE = re.compile(r"/|[A-Za-z]:/")


def container_zones(raw: bytes, locate: Callable[[str, bool], str | None] = lambda path, absolute: path) -> list[dict]:
    """Zones of all programs. Not played: groups on release, muted ones, or all but the soloed ones where a program has such; samples that aren't found."""
    out = []
    for p in programs(raw):
        solo = bool(p["solo"]) and any(g["soloed"] for g in p["groups"])
        for nth, z in enumerate(p["zones"]):
            if z["group"] >= len(p["groups"]) or z["file"] >= len(p["files"]):
                continue
            g, path = p["groups"][z["group"]], p["files"][z["file"]]
            if g["on_release"] or (not g["soloed"] if solo else g["muted"]):
                continue
            file = locate(path, bool(_ABSOLUTE.match(path)))
            if file is None:
                continue
            level, tune = z["volume"] * g["volume"] * p["volume"], z["tune"] * g["tune"] * p["tune"]
            loop, cut = z["loop"], z["cut"]
            out.append(
                {
                    "file": file, **{k: z[k] for k in ("root", "key_low", "key_high", "vel_low", "vel_high")}, "track": bool(g["track"]), "reverse": bool(g["reverse"]),
                    "gain_db": 20 * (math.log10(level) if level > 0 else -120.0), "tune_cents": 1200 * math.log2(tune) if tune > 0 else 0.0, "pan": min(max(z["pan"] + g["pan"] + p["pan"], -1.0), 1.0),
                    "sample_start": z["start"], "sample_stop": z["frames"] - cut if 0 < cut < z["frames"] else 0, "loop_start": loop["start"] if loop else None,
                    "loop_stop": loop["start"] + loop["length"] - 1 if loop else None, "loop_fade_frames": loop["fade"] if loop else 0, "loop_fade_s": 0.0, "group": z["group"] * 1000 + nth,
                }
            )
    return out
