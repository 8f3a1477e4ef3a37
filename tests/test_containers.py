"""Newer sampler containers, built here part by part."""

import struct

import pytest

from tonecairn.sources import containers as C
from tonecairn.sources.programs import NotReadable


def block64(body):
    return struct.pack("<Q", len(body) + 8) + body


def block32(body):
    return struct.pack("<I", len(body)) + body


def text(s):
    return struct.pack("<I", len(s)) + s.encode("utf-16-le")


def part(kind, own=b"", inner=None):
    return block64(struct.pack("<III", 0, kind, 1) + (inner if inner is not None else b"") + own)


def item(*kinds, children=()):
    inner = part(C.END)
    for kind, own in reversed(kinds):
        inner = part(kind, own, inner)
    body = struct.pack("<I4s24x", 1, b"hsin") + inner + struct.pack("<II", 0, len(children)) + b"".join(bytes(12) + c for c in children)
    return block64(body)


def structure(version, public, inner=b""):
    return b"\x01" + struct.pack("<H", version) + block32(b"pp") + block32(public) + block32(inner)


def chunk(kind, body):
    return struct.pack("<H", kind) + block32(body)


def zone(group=0, root=60, file=0, cut=0, loop=b"", version=0x99):
    public = struct.pack("<III4H8xH3f", 7, cut, 0, 1, 127, 10, 90, root, 0.5, 0.75, 2.0) + (bytes(6) if version >= 0x9A else b"") + struct.pack("<I9xI", file, 1000)
    return struct.pack("<I", group) + structure(version, public, chunk(C.LOOPS, loop) if loop else b"")


def group(on_release=0, muted=0, soloed=0, version=0x99):
    return structure(version, text("g") + struct.pack("<3f3B15x2B", 2.0, 0.5, 1.0, 1, 0, on_release, muted, soloed))


def listed(rows):
    return struct.pack("<I", len(rows)) + b"".join(rows)


FILES = struct.pack("<i", 0) + struct.pack("<i", 2) + listed([b"\x03", b"\x02" + text("WAV"), b"\x04" + text("a.wav")]) + listed([b"\x00C ", b"\x02" + text("lib"), b"\x06", b"\x04" + text("b.wav")])


def preset(zones, groups=None, solo=0, files=(C.FILES, FILES)):
    inner = chunk(C.GROUPS, listed(groups or [group()])) + chunk(C.ZONES, listed(zones))
    record = text("P") + bytes(9) + struct.pack("<3f", 1.0, 0.0, 0.5) + bytes(22) + bytes([solo])
    program = chunk(C.BANK, structure(1, b"", chunk(C.PROGRAM, structure(1, record, inner))))
    payload = program + chunk(*files)
    return struct.pack("<8xII4x", 1, len(payload)) + payload


APP = (C.APPLICATION, bytes(5) + struct.pack("<I", 2))
LOOP = struct.pack("<H", 0b101) + struct.pack("<HiII9xI", 0x60, 3, 1, 2, 0) + b"\0" + struct.pack("<HiII9xI", 0x60, 2, 100, 50, 9)


def test_zones_of_a_program():
    raw = item(APP, (C.PRESET, preset([zone(cut=100, loop=LOOP), zone(root=61, file=1, version=0x9B), zone(file=0xFFFFFFFF), zone(group=9), zone(file=5)])))
    a, b = C.container_zones(raw)
    assert (a["file"], a["root"], a["key_low"], a["key_high"], a["sample_start"], a["sample_stop"]) == ("../WAV/a.wav", 60, 10, 90, 7, 900)
    assert (a["loop_start"], a["loop_stop"], a["loop_fade_frames"], a["pan"], a["tune_cents"], a["gain_db"]) == (100, 149, 9, 1.0, 0.0, 0.0)
    assert (b["file"], b["loop_start"], b["sample_stop"], b["group"]) == ("C:/lib/b.wav", None, 0, 1)
    assert [z["file"] for z in C.container_zones(raw, lambda path, absolute: None if absolute else path)] == ["../WAV/a.wav"]


def test_groups_that_do_not_sound():
    groups = [group(), group(on_release=1), group(muted=1), group(soloed=1)]
    roots = lambda solo: [z["root"] for z in C.container_zones(item(APP, (C.PRESET, preset([zone(g, 60 + g) for g in range(4)], groups, solo))))]
    assert roots(0) == [60, 63] and roots(1) == [63]


def test_sub_trees_children_and_lists():
    inside = item((C.PRESET, preset([zone()])))
    packed = b"".join(bytes([len(x) - 1]) + x for x in (inside[k : k + 32] for k in range(0, len(inside), 32)))
    for tree in (struct.pack("<IB", 1, 0) + inside, struct.pack("<IBII", 1, 1, len(inside), len(packed)) + packed):
        assert len(C.container_zones(item(APP, children=[item((C.SUB_TREE, tree))]))) == 1
    newest = struct.pack("<H", 3) + struct.pack("<i8x", 3) + listed([b"\x04" + text("x.wav")]) + bytes(28) + listed([b"\x01" + text("V"), b"\x04" + text("y.wav")])
    assert C.file_list({"kind": C.FILES_EX, "public": newest}) == ["x.wav", "V:/y.wav"]
    assert C.file_list({"kind": C.FILES_EX, "public": struct.pack("<H", 2) + FILES}) == ["../WAV/a.wav", "C:/lib/b.wav"] and C.file_list({"kind": C.FILES, "public": b""}) == []


def test_what_cannot_be_read():
    good = item(APP, (C.PRESET, preset([zone()])))
    protected = item(APP, (C.SUB_TREE, struct.pack("<IBII", 1, 1, 99, 4) + b"\xff\xff\xff\xff"))
    other = item((C.APPLICATION, bytes(5) + struct.pack("<I", 7)), (C.PRESET, preset([zone()])))
    later = item(APP, (C.PRESET, preset([zone(version=0x9D)])))
    listless = item(APP, (C.PRESET, preset([zone()], files=(C.FILES_EX, struct.pack("<H", 9)))))
    for raw in (b"", good[:40], good[:-1], protected, other, later, listless, item(APP), *(good[:k] for k in range(0, len(good), 13))):
        with pytest.raises(NotReadable):
            C.container_zones(raw)
    with pytest.raises(NotReadable, match="protected"):
        C.container_zones(protected)


def test_both_generations_are_read_by_one_reader(spark, tmp_path):
    from tonecairn.sources import readers

    (tmp_path / "WAV").mkdir()
    (tmp_path / "p").mkdir()
    (tmp_path / "WAV/a.wav").write_bytes(b"x")
    (tmp_path / "p/n.nki").write_bytes(item(APP, (C.PRESET, preset([zone()]))))
    (zone_,) = readers.zones(spark, str(tmp_path), "*.nki").collect()
    assert zone_["file"] == f"{tmp_path}/WAV/a.wav" and zone_["error"] is None
