"""Page kernels against plain definitions and drawn pages."""

import itertools
import random
import struct
import zlib

import numpy as np
import pytest

from inkfold.kernels import align, components, lines, raster, source
from inkfold.kernels.natural import natural_key


def mask_of(rows):
    return np.array([[c == "#" for c in r] for r in rows])


def pgm(gray):
    return f"P5\n{gray.shape[1]} {gray.shape[0]}\n255\n".encode() + gray.astype(np.uint8).tobytes()


# scans


def test_decoders_agree():
    gray = np.random.default_rng(1).integers(0, 256, (13, 17)).astype(np.uint8)
    text = "P2 # note\n17 13\n255\n" + " ".join(map(str, gray.ravel()))
    for data in (pgm(gray), text.encode(), raster.write_png(gray)):
        assert np.array_equal(raster.decode(data), gray)
    bits = gray > 128
    plain = b"P1\n17 13\n" + b"\n".join(b"".join(b"01"[v : v + 1] for v in r) for r in bits.astype(int).tolist())
    packed = b"P4\n17 13\n" + np.packbits(bits, axis=1).tobytes()
    assert np.array_equal(raster.decode(plain), np.where(bits, 0, 255)) and np.array_equal(raster.decode(packed), np.where(bits, 0, 255))


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    rgb = np.random.default_rng(kind).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    raw, flat = b"", rgb.reshape(6, 15).astype(int)
    for y in range(6):
        line = []
        for x in range(15):
            a = flat[y, x - 3] if x >= 3 else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - 3] if y and x >= 3 else 0
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c][kind]
            line.append((flat[y, x] - guess) % 256)
        raw += bytes([kind, *line])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert np.array_equal(raster.decode(png), raster.luma(rgb))


@pytest.mark.parametrize("data", [b"", b"P9 1 1", b"P5\n4 4\n255\nab", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"\xff\xd8\xff\xdb\x00", b"P5 100000 100000 255\n"])
def test_bad_scans(data):
    with pytest.raises(raster.ScanError):
        raster.decode(data)


def png_of(raw, width, height, depth, kind, interlace=0, extra=b""):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"\0\0\0\0"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, interlace)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("shape", [(1, 1), (3, 2), (9, 17), (16, 8)])
def test_interlaced_and_deep_pngs(shape):
    gray = np.random.default_rng(2).integers(0, 1 << 16, shape).astype(np.uint16)
    low = (gray >> 8).astype(np.uint8)
    rows = b"".join(b"\0" + r.astype(">u2").tobytes() for r in gray)
    assert np.array_equal(raster.decode(png_of(rows, shape[1], shape[0], 16, 0)), low)
    # each pixel's pass by its place in the 8 x 8 pattern
    pattern = ["16462646", "77777777", "56565656", "77777777", "36463646", "77777777", "56565656", "77777777"]
    raw = b""
    for p in "1234567":
        for y in range(shape[0]):
            own = [low[y, x] for x in range(shape[1]) if pattern[y % 8][x % 8] == p]
            raw += b"\0" + bytes(own) if own else b""
    assert np.array_equal(raster.decode(png_of(raw, shape[1], shape[0], 8, 0, 1)), low)


def test_scans_larger_than_they_are_refused():
    for data in (png_of(b"", 1 << 20, 1 << 20, 8, 0), b"P4\n100000 100000\n", b"P2 99999 99999 255\n1"):
        with pytest.raises(raster.ScanError, match="too large"):
            raster.decode(data)
    bomb = png_of(b"\0" * 50_000_000, 2, 2, 8, 0)  # inflates to no more than its four pixels
    assert raster.decode(bomb).shape == (2, 2)


def jpeg_of(gray, colours=1, factor=1, restart=0, orientation=None):
    """A baseline JPEG of a plain encoder: all codes of eight bits, every quantizer 1; chroma is flat."""
    height, width = gray.shape
    step = 8 * factor
    padded = np.pad(gray, ((0, -height % step), (0, -width % step)), mode="edge").astype(float) - 128
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.where(k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * n + 1) * k * np.pi / 16)
    order = sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8))
    bits, out, since, count = [], b"", 0, 0
    sizes = [(0, factor)] + [(i, 1) for i in range(1, colours)]
    before = [0] * colours

    def put(value, n):
        bits.extend(value >> (n - 1 - i) & 1 for i in range(n))

    def flush():
        nonlocal out
        bits.extend([1] * (-len(bits) % 8))
        out += np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\0")
        bits.clear()

    def signed(v):
        size = abs(v).bit_length()
        return size, v if v >= 0 else v + (1 << size) - 1

    for y in range(0, padded.shape[0], step):
        for x in range(0, padded.shape[1], step):
            if restart and since == restart:
                flush()
                out += bytes([0xFF, 0xD0 + count % 8])
                since, count, before = 0, count + 1, [0] * colours
            since += 1
            for i, f in sizes:
                for dy in range(f):
                    for dx in range(f):
                        cell = padded[y + 8 * dy : y + 8 * dy + 8, x + 8 * dx : x + 8 * dx + 8] if i == 0 else np.zeros((8, 8))
                        z = np.round(c @ cell @ c.T).astype(int).ravel()[order].tolist()
                        size, v = signed(z[0] - before[i])
                        before[i] = z[0]
                        put(size, 8)
                        put(v, size)
                        run = 0
                        last = max((j for j in range(64) if z[j]), default=0)
                        for j in range(1, last + 1):
                            if not z[j]:
                                run += 1
                                continue
                            while run > 15:
                                put(0xF0, 8)
                                run -= 16
                            size, v = signed(z[j])
                            put(run << 4 | size, 8)
                            put(v, size)
                            run = 0
                        if last < 63:
                            put(0, 8)
    flush()
    seg = lambda m, d: bytes([0xFF, m]) + struct.pack(">H", len(d) + 2) + d
    codes = bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255))
    exif = seg(0xE1, b"Exif\0\0MM\0*\0\0\0\x08" + struct.pack(">HHHIHH", 1, 0x0112, 3, 1, orientation, 0)) if orientation else b""
    head = b"\xff\xd8" + exif + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC0, struct.pack(">BHHB", 8, height, width, colours) + b"".join(bytes([i, f << 4 | f, 0]) for i, f in sizes))
    return head + (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xC4, b"\0" + codes + b"\x10" + codes) + seg(0xDA, bytes([colours]) + b"".join(bytes([i, 0]) for i, _ in sizes) + b"\0\x3f\0") + out + b"\xff\xd9"


@pytest.mark.parametrize(("colours", "factor", "restart"), [(1, 1, 0), (1, 1, 3), (3, 1, 0), (3, 2, 2)])
def test_baseline_jpeg(colours, factor, restart):
    gray = np.random.default_rng(colours).integers(0, 256, (37, 45)).astype(np.uint8)
    data = jpeg_of(gray, colours, factor, restart, 6)
    got = raster.decode(data)
    assert got.shape == gray.shape and np.abs(got.astype(int) - gray).max() <= 2
    assert raster.orientation(data) == 6 and raster.orientation(jpeg_of(gray)) is None and raster.orientation(raster.write_png(gray)) is None
    for cut in (20, len(data) // 2):
        with pytest.raises(raster.ScanError):
            raster.decode(data[:cut])
    with pytest.raises(raster.ScanError, match="not baseline"):
        raster.decode(data.replace(b"\xff\xc0", b"\xff\xc2", 1))


def test_otsu_is_the_lowest_best_level():
    rnd = np.random.default_rng(4)
    for _ in range(40):
        gray = rnd.choice(rnd.integers(0, 256, rnd.integers(1, 6)), (9, 9)).astype(np.uint8)
        values = [int(v) for v in gray.ravel()]
        best, at = 0, 0
        from fractions import Fraction

        for t in range(256):
            low, high = [v for v in values if v <= t], [v for v in values if v > t]
            if low and high:
                between = Fraction(len(low) * len(high)) * (Fraction(sum(low), len(low)) - Fraction(sum(high), len(high))) ** 2
                if between > best:
                    best, at = between, t
        assert raster.otsu(gray) == at


def test_bands_margins_and_diagnostics():
    gray = np.full((16, 20), 255, np.uint8)
    for top in (2, 7, 12):
        gray[top : top + 2, 3:17] = 0
    m, _ = raster.measure(gray)
    assert m.bounds == (3, 2, 17, 14) and [(b["y_start"], b["y_end"]) for b in m.bands] == [(2, 4), (7, 9), (12, 14)]
    assert m.margins == (3, 2, 3, 2) and m.band_height == 2 and m.band_pitch == 5 and m.diagnostics == []
    assert raster.measure(np.full((4, 4), 255, np.uint8))[0].diagnostics == ["blank"]
    frame = np.full((16, 20), 255, np.uint8)
    frame[[0, -1]] = 0
    frame[:, [0, -1]] = 0
    assert "border_dominated" in raster.measure(frame)[0].diagnostics
    one = np.full((30, 30), 255, np.uint8)
    one[10:14, 5:25] = 0
    assert raster.measure(one)[0].diagnostics == ["one_band"]


# components


def flooded(mask):
    seen, out = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        todo, cells = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            cells.append((a, b))
            for c, d in itertools.product((a - 1, a, a + 1), (b - 1, b, b + 1)):
                if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not seen[c, d]:
                    seen[c, d] = True
                    todo.append((c, d))
        ys, xs = zip(*cells, strict=True)
        out.append(((int(min(xs)), int(min(ys)), int(max(xs)) + 1, int(max(ys)) + 1), len(cells)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(12))
def test_components_by_flood_fill(seed):
    rnd = np.random.default_rng(seed)
    mask = rnd.random((rnd.integers(1, 25), rnd.integers(1, 25))) < rnd.choice([0.1, 0.35, 0.6])
    got, runs, label = components.labelled(mask)
    assert sorted((b.box, b.ink) for b in got) == flooded(mask)
    assert [b.first for b in got] == list(range(len(got))) and got == sorted(got)
    assert int((runs[:, 2] - runs[:, 1]).sum()) == int(mask.sum()) and len(label) == len(runs)


def test_borders_and_rules_are_taken_away():
    mask = np.zeros((60, 100), bool)
    mask[0], mask[-1], mask[:, 0] = True, True, True
    mask[30, 10:95] = True
    mask[10:16, 20:60] = True
    clean, rejected = components.clean_mask(mask, (0, 0, 100, 60))
    assert [r for r, _ in rejected] == ["page_border", "long_horizontal_rule"]
    assert raster.bounds_of(clean) == (20, 10, 60, 16)


def page_of(widths, top=10, pitch=24, height=14):
    mask = np.zeros((top + pitch * len(widths) + 20, 700), bool)
    for i, w in enumerate(widths):
        for x in range(40, 40 + w, 8):
            mask[top + i * pitch : top + i * pitch + height, x : x + 5] = True
    return mask


def test_candidates_of_a_drawn_page():
    mask = page_of([600, 400, 560, 300, 600])
    box = raster.bounds_of(mask)
    bands = [(b["y_start"], b["y_end"]) for b in raster.ink_bands(mask)]
    got = components.candidates(mask, box, bands)
    assert [c["box"] for c in got["candidates"]] == [(40, 10 + 24 * i, 40 + w - 8 + 5, 24 + 24 * i) for i, w in enumerate([600, 400, 560, 304, 600])]
    assert all(abs(sum(c["profile"]) - 1) < 1e-9 for c in got["candidates"]) and not got["exclusions"]
    head = components.candidates(mask, box, bands, frozenset({0}))
    assert [c["band"] for c in head["candidates"]] == [1, 2, 3, 4] and {r[0] for r in head["rejected"]} == {"running_head"}
    assert components.candidates(mask, box, bands[:1])["exclusions"] == ["insufficient_ink_bands"]
    two = mask.copy()
    two[:, 300:360] = False
    assert "probable_multi_column" in components.candidates(two, box, bands)["exclusions"]


def test_specks_and_rules_of_bands():
    mask = page_of([600] * 6)
    mask[10 + 24 * 2 : 10 + 24 * 3] = False
    mask[62:64, 40:44] = True
    mask[10 + 24 * 4 : 10 + 24 * 5] = False
    mask[110:115, 40:200] = True
    bands = [(b["y_start"], b["y_end"]) for b in raster.ink_bands(mask)]
    reasons = {r[0] for r in components.candidates(mask, raster.bounds_of(mask), bands)["rejected"]}
    assert reasons == {"speck_band", "rule_band"}


# alignment


def every_path(lines_, costs, columns):
    """All monotone paths, by choosing which lines are matched with which candidates and the order of the skips."""

    def walk(r, c):
        if r == len(lines_) and c == columns:
            yield 0.0, ()
            return
        if r < len(lines_) and c < columns:
            for cost, ops in walk(r + 1, c + 1):
                yield costs[r][c] + cost, ((0, lines_[r].ordinal + 1, c + 1), *ops)
        if c < columns:
            for cost, ops in walk(r, c + 1):
                yield 1.0 + cost, ((1, 0, c + 1), *ops)
        if r < len(lines_):
            for cost, ops in walk(r + 1, c):
                yield 1.0 + cost, ((2, lines_[r].ordinal + 1, 0), *ops)

    return sorted(walk(0, 0))


@pytest.mark.parametrize("seed", range(25))
def test_two_best_paths(seed):
    rnd = random.Random(seed)
    rows, columns = rnd.randint(0, 4), rnd.randint(0, 4)
    ls = [align.TextLine(i * 2, "x") for i in range(rows)]
    costs = [[rnd.choice([0.0, 0.25, 0.5, 1.0, 2.0]) for _ in range(columns)] for _ in range(rows)]
    want = every_path(ls, costs, columns)
    assert align.best_paths(ls, costs, columns) == want[:2]


def test_match_costs():
    ls = [align.TextLine(0, "  abcd"), align.TextLine(1, "abc", 2, True)]
    parts = align.match_parts(ls, [(10, 0, 70, 10), (0, 30, 30, 42)], (0, 0, 100, 50))
    assert parts[0][0] == pytest.approx((abs(1 - 0.6), abs(1 - 0.1), 0.0, abs(10 / 11 - 1)))
    assert parts[1][1] == pytest.approx((abs(0.5 - 0.3), 0.0, abs(2 / 3 - 1), abs(12 / 11 - 1.1)))
    assert align.total((1.0, 1.0, 1.0, 1.0)) == 0.55 + 0.25 + 0.15 + 0.05


# lines and glyphs


@pytest.mark.parametrize(("x_height", "stroke"), itertools.product((8, 14, 28, 40), (1, 3, 5)))
def test_line_sweep(x_height, stroke):
    asc, desc = x_height // 2 + 2, x_height // 3 + 2
    mask = np.zeros((asc + x_height + desc + 1, 1600), bool)
    for i, x in enumerate(range(0, 1590, stroke + 6)):
        top = 0 if i % 5 == 0 else asc
        bottom = asc + x_height + (desc if i % 7 == 0 and i % 5 else 0)
        mask[top : bottom + 1, x : x + stroke] = True
    got = lines.measure_line(mask, (0, 0, 1600, mask.shape[0]))
    assert got["measured"] and abs(got["x_height_px"] - x_height) <= 1 and abs(got["baseline_row_px"] - asc - x_height) <= 1
    assert got["stroke_width_px"] == stroke and abs(got["skew_slope"]) < 0.002


def test_short_and_skewed_lines():
    mask = np.zeros((60, 500), bool)
    mask[20:30, ::4] = True
    assert lines.measure_line(mask, (0, 0, 500, 60))["reason"] == "insufficient_segments"
    wide = np.zeros((140, 1600), bool)
    for x in range(0, 1600, 5):
        y = 20 + int(x * 0.05)
        wide[y : y + 14, x : x + 2] = True
    assert lines.measure_line(wide, (0, 0, 1600, 140))["reason"] == "skew_exceeds_maximum"


def test_segments_cover_the_line():
    for width in range(1, 2500, 37):
        cuts = lines.segments(width)
        assert cuts[0][0] == 0 and cuts[-1][1] == width and all(a[1] == b[0] for a, b in itertools.pairwise(cuts))


def test_words_and_glyphs():
    mask = np.zeros((20, 100), bool)
    for x in (2, 7, 12, 30, 35, 60):
        mask[5 : 15 if x != 7 else 12, x : x + 3] = True
    profile = mask.sum(axis=0) / mask.sum()
    got = lines.measure_words(mask, (0, 0, 100, 20), profile.tolist(), "abc de f", 10)
    assert got["words_reconciled"] and got["boxes"] == [(2, 5, 15, 15), (30, 5, 38, 15), (60, 5, 63, 15)]
    assert lines.measure_words(mask, (0, 0, 100, 20), profile.tolist(), "abc de", 10)["boxes"] == []
    word = (2, 5, 15, 15)
    assert lines.cut_word(mask, word, "a’c")["glyphs"] == [("a", 0, (2, 5, 5, 15)), ("c", 2, (12, 5, 15, 15))]
    assert lines.cut_word(mask, word, "ab")["reason"] == "run_count_disagrees"
    assert lines.cut_word(mask, word, "...")["reason"] == "no_labelled_letters"
    assert lines.cut_word(mask, (80, 0, 90, 20), "ab")["reason"] == "no_ink"
    assert lines.crop_to_ink(mask, (0, 0, 20, 20)) == (2, 5, 15, 15) and lines.crop_to_ink(mask, (80, 0, 90, 20)) is None


def test_masks_are_checked_exactly():
    mask = mask_of(["#.#", ".##"])
    columns = [1 / 4, 1 / 4, 2 / 4]
    good = (0, (0, 0, 3, 2), 4, columns)
    assert lines.mask_fault(mask, [good]) is None and lines.mask_fault(mask, []) is None
    assert lines.mask_fault(mask, [good, (7, (0, 0, 3, 2), 5, columns)]) == ("foreground_pixels_mismatch", 7)
    assert lines.mask_fault(mask, [(2, (0, 0, 3, 2), 4, [1 / 4, 2 / 4, 1 / 4])]) == ("horizontal_ink_profile_mismatch", 2)
    assert lines.clipped((-3, 1, 9, 9), mask) == (0, 1, 3, 2) and lines.clipped((3, 0, 9, 2), mask) is None


def test_resize_is_a_triangle_filter_in_two_rounded_passes():
    from fractions import Fraction

    def passed(values, m):
        n, out = len(values), []
        scale = Fraction(n, m)
        reach = max(scale, 1)
        for k in range(m):
            center = (k + Fraction(1, 2)) * scale
            w = [max(Fraction(0), 1 - abs((i + Fraction(1, 2) - center) / reach)) for i in range(n)]
            out.append(float(sum(a * b for a, b in zip(w, values, strict=True)) / sum(w)))
        return out

    for shape_ in ((5, 3), (16, 12), (40, 25), (1, 1)):
        gray = np.random.default_rng(shape_[0]).integers(0, 256, shape_).astype(np.uint8)
        wide = [[int(v + 0.5) for v in passed(list(map(int, r)), 12)] for r in gray]
        want = np.array([passed(list(c), 16) for c in zip(*wide, strict=True)]).T
        got = 255 - lines.shape(gray).astype(int)
        assert np.abs(got - want).max() <= 1  # half a level of rounding, and half of one that fell on a tie before
    assert not lines.shape(np.zeros((0, 4), np.uint8)).any()


def test_unlike_a_character():
    rnd = np.random.default_rng(5)
    usual = [np.clip(np.full((16, 12), 100) + rnd.integers(-9, 10, (16, 12)), 0, 255).astype(np.uint8) for _ in range(70)]
    ref = lines.shape_reference(usual)
    assert lines.shape_reference(usual[:59]) is None and not any(lines.unlike(g, ref) for g in usual[:20])
    assert lines.unlike(np.zeros((16, 12), np.uint8), ref)
    away = sorted(float(np.sqrt(((g.astype(np.float32) - np.median(np.stack(usual).astype(np.float32), axis=0)) ** 2).sum()) / 255) for g in usual)
    assert ref["scatter"] == pytest.approx(away[66])
    assert not lines.unlike(np.zeros((16, 12), np.uint8), ref | {"scatter": 0.0})


def test_feature_evidence():
    text = "plain    x\n/*\na    1\nb    2\nc    3\n*/\n[Illustration: a]"
    page = source.tokenize({"p": text})[0]
    assert source.feature_evidence(page, ["table_like", "illustration_or_ornament"]) == {"table_like": [2, 3, 4], "illustration_marker": [6]}
    with pytest.raises(ValueError, match="table_like"):
        source.feature_evidence(source.tokenize({"p": "/*\na    1\n*/"})[0], ["table_like"])
    assert source.feature_evidence(page | {"spans": None}, ["table_like"]) == {"table_like": []}


def test_shapes_and_atlas():
    rnd = np.random.default_rng(0)
    grids = [lines.shape(np.where(rnd.random((20, 14)) < 0.5, 0, 255)) for _ in range(70)]
    ref = lines.shape_reference(grids)
    assert grids[0].shape == (16, 12) and ref["scatter"] > 0 and lines.shape_reference(grids[:59]) is None
    assert lines.shape_distance(grids[0], ref) < lines.shape_distance(255 - grids[0] * 0, ref) + 10
    sheet = lines.atlas_sheet([np.zeros((4, 3), np.uint8), np.zeros((9, 9), np.uint8)], 5, 6)
    assert sheet.shape == (8, 193) and sheet[0, 0] == 160 and sheet[1, 1] == 255 and (sheet[2:6, 2:5] == 0).all() and (sheet[1:7, 7:12] == 0).all()


# transcriptions


def test_natural_order_folds_case():
    assert natural_key("Straße") == (*natural_key("STRASSE")[:-1], natural_key("Straße")[-1])
    assert sorted(["p10", "p002", "p2", "P02", "p1"], key=natural_key) == ["p1", "p2", "P02", "p002", "p10"]
    assert sorted(["p02", "P02"], key=natural_key) == ["P02", "p02"]


def test_natural_order():
    assert sorted(["p10", "p002", "p2", "P02", "p1"], key=natural_key) == ["p1", "p2", "P02", "p002", "p10"]
    assert sorted(["p02", "P02", ""], key=natural_key) == ["", "P02", "p02"]


def test_markup_and_notes():
    page = source.tokenize({"p1": "a <i>bc</i>[** note]\r\n<tb>\nd<x>e <b>f"})[0]
    assert page["visible_text"] == "a bc\n\nd<x>e f"
    assert [(s["kind"], s["start"], s["end"]) for s in page["styles"]] == [("i", 2, 4), ("tb", 5, 5)]
    assert [d["code"] for d in page["diagnostics"]] == ["unknown_tag", "unmatched_style_tag"]
    assert [x["visible_text"] for x in page["lines"]] == ["a bc", "", "d<x>e f"] and [x["style_eligible"] for x in page["lines"]] == [True, True, False]


def test_blocks_cross_pages():
    pages = source.tokenize({"p10": "end #/ after", "p2": "x /#\nstart", "p3": "middle", "p11": "/* open"})
    spans = [[(s["kind"], s["closed"]) for s in p["spans"]] for p in pages]
    assert spans == [[("continued", True)], [("continued", True)], [("continued", True)], [("local", False)]]
    assert [p["visible_text"] for p in pages] == ["x \nstart", "middle", "end  after", "/* open"]
    assert len({s["block_id"] for p in pages[:3] for s in p["spans"]}) == 1
    assert pages[3]["lines"][0]["matching_eligible"] is False
    nested = source.tokenize({"p1": "/* a /* b */ c", "p2": "*/"})
    assert [d["code"] for d in nested[0]["diagnostics"]] == ["malformed_control"] and nested[1]["lines"][0]["matching_eligible"] is False


@pytest.mark.parametrize("seed", range(30))
def test_operations_partition_the_source(seed):
    rnd = random.Random(seed)
    bits = ["/*", "*/", "/#", "#/", "<i>", "</i>", "<b x='1'>", "</b>", "<", ">", "[**", "]", "\n", "\r\n", "é", "ab", " ", "<tb/>", "</x>", "< i"]
    text = {f"p{i}": "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for i in range(4)}
    for page in source.tokenize(text):
        raw, at = text[page["page_name"]].encode(), 0
        for o in page["operations"]:
            assert o["byte_start"] == at
            at = o["byte_end"]
            assert o["output"] in (raw[o["byte_start"] : at].decode(), "", "\n")
        assert at == len(raw) and page["lines"][-1]["byte_end"] == len(raw)
        assert "".join(o["output"] for o in page["operations"]) == page["visible_text"]
        assert sum(x["operations"] for x in page["lines"]) == len(page["operations"])
        for a, b in itertools.pairwise(page["lines"]):
            assert a["byte_end"] == b["byte_start"] and a["ordinal"] + 1 == b["ordinal"]


def test_overlays():
    from inkfold.kernels import overlay

    gray = np.full((40, 60), 255, np.uint8)
    page = overlay.page_overlay(gray, [(5, 5, 20, 12), (30, 5, 50, 12)], {0}, True)
    back = raster.decode(page)
    assert back.shape == gray.shape and back[5, 5] == raster.luma(np.array([[overlay.ACCEPTED]]))[0, 0] and back[5, 30] == raster.luma(np.array([[overlay.SKIPPED]]))[0, 0] and back[8, 8] == 255
    line = raster.decode(overlay.line_overlay(gray, (4, 10, 30, 20), 18, 12))
    assert line.shape == (26, 38) and (line[16] == raster.luma(np.array([[overlay.BASELINE]]))[0, 0]).all()
