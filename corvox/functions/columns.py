"""Column functions: identifiers, paths, geometry, intensities and material weights."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space that text is stripped of, not blanks alone.
WHITE = " \t\n\r\x0b\x0c"


def suffix(path: Column) -> Column:
    """Lower-cased file suffix with its dot, '' if none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def sequence_id(path: Column, depth: int) -> Column:
    """First `depth` directories of a path; 'default' for depth 0 or a bare file name."""
    parts = F.split(path, "/")
    n = F.least(F.lit(depth), F.size(parts) - 1)
    return F.when(n > 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(n, F.lit(1))), "/")).otherwise("default")


def safe_name(text: Column, fallback: str, strip: str = "-") -> Column:
    """Runs outside letters, digits, '_', '.', '-' become '-'; ends are stripped."""
    edge = "[" + strip.replace("-", r"\-") + "]+"
    clean = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "-"), f"^{edge}|{edge}$", "")
    return F.when(F.length(clean) > 0, clean).otherwise(fallback)


def frame_id(case: Column, sequence: Column, index: Column) -> Column:
    return F.concat_ws("_", safe_name(case, "default"), safe_name(sequence, "default"), F.format_string("%06d", index))


def frame_time(index: Column, fps: float | None) -> Column:
    """Seconds; null without a frame rate."""
    if fps is not None and fps <= 0:
        raise ValueError("fps must be positive")
    return index / F.lit(fps).cast("double")


def relative_path(path: Column, base: Column) -> Column:
    """Path relative to base, unchanged when outside it."""
    inside = F.startswith(path, F.concat(base, F.lit("/")))
    return F.when(inside, F.substr(path, F.length(base) + 2)).otherwise(path)


def folded(part: Column) -> Column:
    return F.replace(F.lower(part), F.lit("-"), F.lit("_"))


def category_index(parts: Column, known: list[str]) -> Column:
    """1-based place of the first part that is a known category, 0 if none."""
    return F.coalesce(F.array_position(F.transform(parts, lambda p: F.when(folded(p).isin(known), 1).otherwise(0)), 1), F.lit(0)).cast("int")


def patient_video(parts: Column, index: Column) -> tuple[Column, Column]:
    """Patient and video from the parts after the category."""
    after = F.when(index > 0, F.slice(parts, F.greatest(index, F.lit(1)) + 1, F.size(parts)))
    after = F.when(F.lower(F.try_element_at(after, F.lit(1))).isin("imgs", "images"), F.slice(after, 2, F.size(parts))).otherwise(after)
    n = F.size(after)
    return F.when(n >= 2, F.try_element_at(after, F.lit(1))), F.when(n >= 3, F.try_element_at(after, F.lit(2))).when(n == 2, ".")


CASE_ID = r"^[A-Za-z0-9][A-Za-z0-9_.\-]*$"


def valid_case_id(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(CASE_ID)), F.lit(False))


def pseudonym(text: Column) -> Column:
    """'sha256:' and the hash of the stripped text; null for null or blank."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.length(bare) > 0, F.concat(F.lit("sha256:"), F.sha2(bare, 256)))


def big_endian(content: Column, at: int) -> Column:
    """Unsigned 32-bit number at a 0-based byte place."""
    return F.conv(F.hex(F.substring(content, at + 1, 4)), 16, 10).cast("int")


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height of a PNG file's bytes, else null."""
    ok = (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (F.octet_length(content) >= 24)
    return F.when(ok, big_endian(content, 16)), F.when(ok, big_endian(content, 20))


def affine(m: list[Column], x: Column, y: Column, z: Column) -> list[Column]:
    """Point through the 12 row-major coefficients of an affine transform."""
    return [m[4 * i] * x + m[4 * i + 1] * y + m[4 * i + 2] * z + m[4 * i + 3] for i in range(3)]


def inverse_affine(m: list[Column]) -> list[Column]:
    """The 12 coefficients of the inverse, by the adjugate; an error if singular."""
    a = [[m[4 * i + j] for j in range(3)] for i in range(3)]
    minor = lambda i, j: a[(i + 1) % 3][(j + 1) % 3] * a[(i + 2) % 3][(j + 2) % 3] - a[(i + 1) % 3][(j + 2) % 3] * a[(i + 2) % 3][(j + 1) % 3]
    det = sum((a[0][j] * minor(0, j) for j in range(1, 3)), a[0][0] * minor(0, 0))
    det = F.when(det == 0, F.raise_error(F.lit("singular transform")).cast("double")).otherwise(det)
    out = []
    for i in range(3):
        row = [minor(j, i) / det for j in range(3)]
        out += [*row, -(row[0] * m[3] + row[1] * m[7] + row[2] * m[11])]
    return out


def dot(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def quaternion_angle(p: Column, q: Column) -> Column:
    """Geodesic angle between unit quaternions in degrees."""
    return F.degrees(2 * F.acos(F.least(F.abs(dot(p, q)), F.lit(1.0))))


def focal_length(width: Column, height: Column, fov_deg: Column) -> Column:
    """Focal length in pixels of a diagonal field of view."""
    return F.sqrt(width * width + height * height) / (2 * F.tan(F.radians(fov_deg) / 2))


def rescaled(pixel: Column, slope: Column, intercept: Column) -> Column:
    """Slope and intercept as text or number; missing or unreadable ones are 1 and 0."""
    return pixel * F.coalesce(slope.try_cast("double"), F.lit(1.0)) + F.coalesce(intercept.try_cast("double"), F.lit(0.0))


def depth_from_buffer(buffer: Column, most: float) -> Column:
    """Metric depth: the negated buffer, at least 0 and at most `most`; `most` where not finite."""
    odd = F.isnan(buffer) | buffer.isNull() | (F.abs(buffer) == float("inf"))
    return F.when(odd, F.lit(most)).otherwise(F.least(F.greatest(-buffer, F.lit(0.0)), F.lit(most)))


def depth_code(depth: Column, most: float) -> Column:
    """16-bit code, rounded half to even."""
    return F.bround(F.least(F.greatest(depth / most, F.lit(0.0)), F.lit(1.0)) * 65535, 0).cast("int")


def in_aperture(row: Column, col: Column, h: int, w: int) -> Column:
    return F.sqrt((row - (h - 1) / 2) ** 2 + (col - (w - 1) / 2) ** 2) <= 0.485 * min(h, w)


def windowed(value: Column, center: float, width: float, truncate: bool = False) -> Column:
    """CT window to 0..255, rounded half to even or cut."""
    low = center - width / 2
    x = (F.least(F.greatest(value, F.lit(low)), F.lit(center + width / 2)) - low) / width * 255
    return (F.floor(x) if truncate else F.bround(x, 0)).cast("int")


def smoothstep(x: Column, low: float, high: float) -> Column:
    t = F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def normalized(x: Column, low: Column, high: Column) -> Column:
    """Min-max scaling with a span of at least 1e-6."""
    return (x - low) / F.greatest(high - low, F.lit(1e-6))


def region(generation: Column, radius_norm: Column) -> Column:
    """Anatomy region 0..3 by generation; wide places are region 0."""
    return F.when((radius_norm > 0.86) | (generation <= 0.5), 0).when(generation <= 1.5, 1).when(generation <= 3.5, 2).otherwise(3)


def volume_ml(voxels: Column, spacing: list[Column]) -> Column:
    """Airway volume in millilitres; missing voxels are 0, missing spacing the corpus default."""
    out = F.coalesce(voxels, F.lit(0)).cast("double")
    for s, d in zip(spacing, (0.747, 0.747, 1.2218), strict=True):
        out = out * F.coalesce(s, F.lit(d))
    return out / 1000


def unit(v: list[Column], fallback: tuple[float, float, float]) -> list[Column]:
    n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return [F.when(n > 0, x / n).otherwise(F.lit(f)) for x, f in zip(v, fallback, strict=True)]


def cross(p: list[Column], q: list[Column]) -> list[Column]:
    return [p[(i + 1) % 3] * q[(i + 2) % 3] - p[(i + 2) % 3] * q[(i + 1) % 3] for i in range(3)]


def sector(dx: Column, dy: Column) -> Column:
    return F.concat_ws("-", F.when(dx >= 0, "right").otherwise("left"), F.when(dy >= 0, "upper").otherwise("lower"))


def name_phase(name: Column) -> Column:
    """Phase of an entry's texture: sum of (i + 1) * character code, modulo 997, as a part of a turn."""
    codes = F.transform(F.split(name, ""), lambda c, i: (i + 1) * F.ascii(c))
    return F.aggregate(codes, F.lit(0).cast("int"), lambda s, x: (s + x).cast("int")) % 997 / 997 * 2 * pi


def texture(name: Column, x: Column, y: Column, z: Column, scale: float = 3.0) -> Column:
    """Display-channel modulation in 0..1 of a normalised point."""
    p, k = name_phase(name), max(scale, 1e-6)
    wave = 0.5 + 0.22 * F.sin(k * (1.7 * x - 0.9 * y + 1.1 * z) + p) + 0.18 * F.cos(k * (0.6 * x + 1.3 * y - 1.5 * z) - 0.5 * p) + 0.1 * F.sin(0.55 * k * (x + y) + 0.7 * p)
    return F.least(F.greatest(wave, F.lit(0.0)), F.lit(1.0))


def region_weights(generation: Column, distance: Column, radius: Column, softness: float) -> list[Column]:
    """How far a point belongs to each of the four regions, with edges as soft as given."""
    s = max(softness, 1e-4)
    near = smoothstep(radius, 0.86 - s / 2, 0.86 + s / 2)
    step = lambda at: smoothstep(generation, at - s, at + s)
    less = 1 - 0.65 * near
    return [
        F.greatest(1 - step(0.5), 1 - smoothstep(distance, 0.14, 0.34 + 0.08 * s), near),
        step(0.5) * (1 - step(1.5)) * less,
        step(1.5) * (1 - step(3.5)) * less,
        F.greatest(step(3.5), smoothstep(distance, 0.52 - 0.05 * s, 0.72 + 0.08 * s)) * less,
    ]


def soft_weights(generation: Column, distance: Column, radius: Column, softness: float = 0.15) -> list[Column]:
    """Weights of the four regions that add up to 1; region 3 alone where all are zero."""
    raw = [F.greatest(w, F.lit(0.0)) for w in region_weights(generation, distance, radius, softness)]
    total = raw[0] + raw[1] + raw[2] + raw[3]
    return [F.when(total > 1e-6, w / total).otherwise(F.lit(float(i == 3))) for i, w in enumerate(raw)]
