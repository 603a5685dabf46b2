"""Image checks on decoded grey images: kernels in numpy, one pass over the figures.

An image is ``height``, ``width`` and ``content`` (grey bytes, row by row). Codecs aren't part of
this library: decode with Spark's image source or a reader of your own first.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
log = logging.getLogger(__name__)


def dct_matrix(n: int) -> np.ndarray:
    k = np.arange(n)
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def resize(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Area means."""
    rows = np.linspace(0, img.shape[0], h + 1)
    cols = np.linspace(0, img.shape[1], w + 1)
    total = np.pad(img.astype(float).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    r, c = rows.astype(int), cols.astype(int)
    r[1:], c[1:] = np.maximum(r[1:], r[:-1] + 1), np.maximum(c[1:], c[:-1] + 1)
    r, c = np.minimum(r, img.shape[0]), np.minimum(c, img.shape[1])
    area = np.maximum(np.outer(np.diff(r), np.diff(c)), 1)
    s = total[np.ix_(r, c)]
    return (s[1:, 1:] - s[:-1, 1:] - s[1:, :-1] + s[:-1, :-1]) / area


def perceptual_hash(img: np.ndarray, size: int = 16) -> str:
    """Hex of the signs of low DCT frequencies against their median."""
    n = 4 * size
    d = dct_matrix(n)
    low = (d @ resize(img, n, n) @ d.T)[:size, :size]
    return np.packbits(low > np.median(low)).tobytes().hex()


def average_hash(img: np.ndarray, size: int = 16) -> str:
    small = resize(img, size, size)
    return np.packbits(small > small.mean()).tobytes().hex()


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Mean structural similarity over 7x7 windows of the common part; whole-image for tiny ones."""
    h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    a, b = a[:h, :w].astype(float), b[:h, :w].astype(float)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    if min(h, w) < 7:
        mean = lambda x: x.mean()
    else:

        def mean(x: np.ndarray) -> np.ndarray:
            t = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            return (t[7:, 7:] - t[:-7, 7:] - t[7:, :-7] + t[:-7, :-7]) / 49

    ma, mb = mean(a), mean(b)
    va, vb, cov = mean(a * a) - ma**2, mean(b * b) - mb**2, mean(a * b) - ma * mb
    return float(np.mean((2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))))


def noise_ratio(img: np.ndarray) -> float:
    """Largest ratio of Laplacian variances between blocks of like brightness."""
    x = img.astype(float)
    lap = np.zeros_like(x)
    lap[1:-1, 1:-1] = x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]
    bins: dict[int, list[float]] = {}
    for i in range(0, img.shape[0] - BLOCK + 1, BLOCK):
        for j in range(0, img.shape[1] - BLOCK + 1, BLOCK):
            bins.setdefault(int(x[i : i + BLOCK, j : j + BLOCK].mean()) // 32, []).append(float(lap[i : i + BLOCK, j : j + BLOCK].var()))
    ratios = [min(max(v) / max(min(v), 0.5), 200.0) for v in bins.values() if len(v) > 1]
    return max(ratios, default=0.0)


PEAK_SCORE = 2.5


def spectrum(img: np.ndarray) -> tuple[int, float, float]:
    """Of the radial profile of log magnitudes: periodic peaks, the share of high to low frequencies,
    and how far it is from a power law (root mean square in log-log)."""
    n = min(img.shape) // 2
    if n < 2:
        return 0, 1.0, 0.0
    magnitude = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(img.astype(float)))))
    y, x = np.indices(img.shape)
    r = np.minimum(np.hypot(y - img.shape[0] // 2, x - img.shape[1] // 2).astype(int), n - 1).ravel()
    profile = np.bincount(r, magnitude.ravel(), n) / np.maximum(np.bincount(r, minlength=n), 1)
    width = max(3, n // 20)
    rest = profile - (np.convolve(profile, np.ones(width) / width, "same") if n > 10 else profile.mean())
    power = np.abs(np.fft.fft(rest))[2 : n // 2]
    peaks = int((power > power.mean() + PEAK_SCORE * power.std()).sum()) if power.size and power.std() > 0 else 0
    low = profile[1 : n // 3 + 1].mean() if n // 3 > 1 else 0.0
    share = profile[2 * n // 3 :].mean() / max(low, 1e-10)
    at, value = np.log1p(np.arange(1, n)), np.log1p(np.maximum(profile[1:], 0))
    at, value = at[value > 0], value[value > 0]
    off = float(np.sqrt(np.mean((value - np.polyval(np.polyfit(at, value, 1), at)) ** 2))) if len(at) > 2 else 0.0
    return peaks, float(share), off


def spectrum_finding(peaks: int, share: float, off: float) -> tuple[str, float] | None:
    """The distance from the power law decides the severity, but not whether there is a finding."""
    if not peaks and share >= 0.1:
        return None
    if off > 5:
        return "high", min(off / 10, 0.85)
    return ("medium", min(off / 8, 0.7)) if off > 3 else ("low", min(off / 6, 0.5))


QUANT = np.array(
    [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
     18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
).reshape(8, 8)  # fmt: skip  # the luminance table of the JPEG standard: fixed values


def blocks8(img: np.ndarray) -> np.ndarray:
    h, w = img.shape[0] // 8 * 8, img.shape[1] // 8 * 8
    return img[:h, :w].astype(float).reshape(h // 8, 8, w // 8, 8).swapaxes(1, 2)


def recompressed(img: np.ndarray, quality: int) -> np.ndarray:
    """The image after quantising its 8x8 blocks as JPEG of that quality does (grey, whole blocks)."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    q = np.clip((QUANT * scale + 50) // 100, 1, 255)
    d = dct_matrix(8)
    c = np.rint((d @ (blocks8(img) - 128) @ d.T) / q) * q
    out = np.clip(np.rint(d.T @ c @ d) + 128, 0, 255)
    return out.swapaxes(1, 2).reshape(out.shape[0] * 8, -1)


def error_level(img: np.ndarray, quality: int = 80) -> tuple[float, float, float]:
    """Largest, mean and spread of what recompression changes."""
    again = recompressed(img, quality)
    diff = np.abs(img[: again.shape[0], : again.shape[1]].astype(float) - again)
    return float(diff.max()), float(diff.mean()), float(diff.std())


def error_level_finding(most: float, mean: float, spread: float) -> tuple[str, float] | None:
    if not (most >= 15 and most > mean + 2 * spread):
        return None
    z = (most - mean) / (spread + 1e-6)
    if most >= 60 and most > mean + 3 * spread:
        return "high", min(max(z / 15, most / 100), 0.85)
    if most >= 40:
        return "medium", min(max(z / 20, most / 70), 0.75)
    if most >= 25:
        return "low", min(max(z / 25, most / 50), 0.65)
    return "low", min(max(z / 30, most / 60), 0.5)


def double_compression(img: np.ndarray) -> float:
    """Mean of the ten strongest periodicities among the histograms of 63 DCT modes."""
    d = dct_matrix(8)
    c = (d @ (blocks8(img) - 128) @ d.T).reshape(-1, 64)
    scores = []
    for mode in range(1, 64):
        h, _ = np.histogram(np.clip(np.rint(c[:, mode]), -128, 127), bins=256, range=(-128, 128))
        h = h - h.mean()
        power = (h * h).sum()
        scores.append(max(((h[lag:] * h[:-lag]).sum() / power for lag in range(2, 21)), default=0.0) if power else 0.0)
    return float(np.mean(sorted(scores)[-10:]))


def ghosts(img: np.ndarray, qualities: tuple[int, ...] = tuple(range(50, 100, 5))) -> tuple[int, float, float]:
    """Blocks whose best-fitting quality is ten or more off the median, the variance of the best, and
    the share of such blocks."""
    diffs = []
    for q in qualities:
        again = recompressed(img, q)
        e = (img[: again.shape[0], : again.shape[1]] - again) ** 2
        h, w = e.shape[0] // BLOCK * BLOCK, e.shape[1] // BLOCK * BLOCK
        diffs.append(e[:h, :w].reshape(h // BLOCK, BLOCK, w // BLOCK, BLOCK).mean(axis=(1, 3)).ravel())
    best = np.array(qualities)[np.argmin(diffs, axis=0)] if diffs[0].size else np.empty(0)
    off = np.abs(best - np.median(best)) >= 10 if best.size else best.astype(bool)
    return (int(off.sum()), float(best.var()), float(off.mean())) if best.size else (0, 0.0, 0.0)


def ghost_finding(n: int, variance: float, share: float) -> tuple[str, float] | None:
    if not n or not (variance > 25 or share > 0.05):
        return None
    return ("high", min(0.85, 0.5 + 0.1 * n)) if n >= 3 or variance > 100 else ("medium", min(0.7, 0.4 + 0.1 * n))


def energy_outliers(img: np.ndarray) -> int:
    """8x8 blocks whose energy (without the mean) is over three deviations off the average one."""
    d = dct_matrix(8)
    e = ((d @ (blocks8(img) - 128) @ d.T) ** 2).sum(axis=(2, 3)) - (d @ (blocks8(img) - 128) @ d.T)[:, :, 0, 0] ** 2
    return int((np.abs(e - e.mean()) > 3 * e.std()).sum()) if e.size and e.std() > 0 else 0


def block_clones(img: np.ndarray, size: int = 16, stride: int = 4, near: float = 10.0, apart: float = 40.0) -> tuple[int, float, tuple[int, int]]:
    """Votes for the commonest displacement of like blocks, its share of all votes, and itself.

    Blocks are sorted by their low DCT coefficients; neighbours in that order are compared.
    """
    d = dct_matrix(size)[:8]
    at = [(i, j) for i in range(0, img.shape[0] - size + 1, stride) for j in range(0, img.shape[1] - size + 1, stride)]
    if len(at) < 2:
        return 0, 0.0, (0, 0)
    f = np.stack([(d @ img[i : i + size, j : j + size].astype(float) @ d.T).ravel() for i, j in at])
    order = np.lexsort(np.rint(f[:, ::-1]).T)
    f, at = f[order], np.array(at)[order]
    like = np.flatnonzero(np.sqrt(((f[1:] - f[:-1]) ** 2).sum(1)) < near)
    shift = at[like + 1] - at[like]
    shift = shift[np.hypot(*shift.T) > apart]
    if not len(shift):
        return 0, 0.0, (0, 0)
    shift = np.where((shift[:, :1] < 0) | ((shift[:, :1] == 0) & (shift[:, 1:] < 0)), -shift, shift)
    unit = max(stride, 2)
    values, counts = np.unique(np.rint(shift / unit).astype(int) * unit, axis=0, return_counts=True)
    k = int(np.argmax(counts))
    return int(counts[k]), float(counts[k] / counts.sum()), (int(values[k][0]), int(values[k][1]))


#: Pixels around a displacement in which copies are looked for, the mean difference under which a
#: block counts as copied, and the share of copied blocks that confirms a clone.
SEARCH, COPIED, CONFIRMED = 4, 15.0, 0.10


def copied_share(img: np.ndarray, shift: tuple[int, int], size: int = 16) -> float:
    """The largest share of blocks that reappear at a displacement (rows, columns) or close to it."""
    best, x = 0.0, img.astype(float)
    for di in range(-SEARCH, SEARCH + 1, 2):
        for dj in range(-SEARCH, SEARCH + 1, 2):
            i, j = shift[0] + di, shift[1] + dj
            h, w = (x.shape[0] - abs(i)) // size * size, (x.shape[1] - abs(j)) // size * size
            if h <= 0 or w <= 0:
                continue
            a, b = x[max(0, -i) :, max(0, -j) :][:h, :w], x[max(0, i) :, max(0, j) :][:h, :w]
            off = np.abs(a - b).reshape(h // size, size, w // size, size).mean(axis=(1, 3))
            best = max(best, float((off < COPIED).mean()))
    return best


def clone_finding(votes: int, share: float, copied: float) -> tuple[str, float] | None:
    if votes < 8 or share < 0.5 or copied < CONFIRMED:
        return None
    if share >= 0.7 and copied >= 0.3:
        return "high", min(0.65 + 0.2 * share, 0.85)
    return ("medium", min(0.45 + 0.3 * share, 0.75)) if copied >= 0.15 else ("low", min(0.3 + 0.3 * share, 0.6))


def smoothed(profile: np.ndarray) -> np.ndarray:
    """Gaussian means over about a fiftieth of the profile, mirrored at the ends."""
    k = max(5, len(profile) // 50) | 1
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-0.5 * ((np.arange(k) - k // 2) / sigma) ** 2)
    return np.convolve(np.pad(profile, k // 2, mode="reflect"), kernel / kernel.sum(), "valid")


def lanes(img: np.ndarray, least: int = 15) -> list[tuple[int, int]]:
    """Runs of columns that are brighter than 0.7 of the mean and than a quarter of the columns."""
    if img.shape[1] < 6:
        return []
    smooth = smoothed(img.astype(float).mean(axis=0))
    on = np.concatenate([[False], smooth > max(0.7 * smooth.mean(), np.percentile(smooth, 25)), [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least]


def bands(profile: np.ndarray) -> list[int]:
    """Places of the local maxima above the mean."""
    inner = profile[1:-1]
    return (np.flatnonzero((inner > profile[:-2]) & (inner > profile[2:]) & (inner > profile.mean())) + 1).tolist() if len(profile) > 2 else []


def lane_correlations(img: np.ndarray) -> list[tuple[int, int, float]]:
    """Correlation of the row profiles of each pair of lanes; 0 for flat ones and under five rows."""
    rows = [img[:, a:b].astype(float).mean(axis=1) for a, b in lanes(img)]
    level = lambda x, y: len(x) < 5 or not x.std() or not y.std()
    return [(i, j, 0.0 if level(rows[i], rows[j]) else float(np.corrcoef(rows[i], rows[j])[0, 1])) for i in range(len(rows)) for j in range(i + 1, len(rows))]


def splices(img: np.ndarray) -> list[tuple[int, float]]:
    """(column, confidence) of borders between lanes whose two sides differ in level or noise."""
    x, found, out = img.astype(float), lanes(img), []

    def roughness(side: np.ndarray) -> float:
        p = np.pad(side, 1, mode="reflect") if min(side.shape) > 1 else np.pad(side, 1, mode="edge")
        return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * side).var())

    for (_, left), (right, _) in zip(found[:-1], found[1:], strict=True):
        a, b = max(0, left - 3), min(x.shape[1], right + 3)
        before, after = x[:, max(0, a - 5) : a], x[:, b : b + 5]
        if b - a < 2 or not before.size or not after.size:
            continue
        n, m = roughness(before), roughness(after)
        confidence = min((abs(before.mean() - after.mean()) / 30 + abs(n - m) / max(n, m, 1.0)) / 2, 1.0)
        if confidence > 0.3:
            out.append(((a + b) // 2, float(confidence)))
    return out


def blot_findings(img: np.ndarray) -> list[tuple[str, str, float]]:
    """Duplicated lanes, splices, and lanes that are all alike; of two lanes and more."""
    pairs, seams = lane_correlations(img), splices(img)
    doubles = [c for _, _, c in pairs if c > 0.95]
    alike = bool(pairs) and np.mean([c for _, _, c in pairs]) > 0.85
    out = []
    if doubles or alike or any(c > 0.6 for _, c in seams):
        out += [("western_blot", "high", min(c, 1.0)) for c in doubles]
        out += [("western_blot", "high" if c > 0.7 else "medium", c) for _, c in seams if c > 0.5]
        if alike and not doubles:
            out.append(("western_blot", "medium", 0.6))
    return out


def _noise(img: np.ndarray) -> tuple[str, float] | None:
    r = noise_ratio(img)
    return ("high", min(r / 80, 0.85)) if r > 50 else ("medium", min(r / 60, 0.7)) if r > 25 else None


def _double_jpeg(img: np.ndarray) -> tuple[str, float] | None:
    s = double_compression(img)
    if s < 0.3:
        return None
    return ("high", min(s, 0.9)) if s > 0.7 else ("medium", min(0.8 * s, 0.75)) if s > 0.5 else ("low", min(0.6 * s, 0.5))


def _clones(img: np.ndarray) -> tuple[str, float] | None:
    votes, share, shift = block_clones(img)
    return clone_finding(votes, share, copied_share(img, shift) if votes >= 8 and share >= 0.5 else 0.0)


CHECKS: dict[str, Callable] = {
    "ela": lambda img: error_level_finding(*error_level(img)),
    "clone_detection": _clones,
    "noise_analysis": _noise,
    "dct_analysis": _double_jpeg,
    "jpeg_ghost": lambda img: ghost_finding(*ghosts(img)),
    "fft_analysis": lambda img: spectrum_finding(*spectrum(img)),
}


def findings_of(img: np.ndarray, checks: dict[str, Callable] | None = None, blot: bool = False) -> list[tuple[str, str, float]]:
    """(method, severity, confidence) of all checks; one that fails is logged and leaves the others alone."""
    out: list[tuple[str, str, float]] = []
    for method, check in (CHECKS if checks is None else checks).items():
        try:
            if found := check(img):
                out.append((method, *found))
        except Exception:
            log.exception("check %s failed", method)
    if blot:
        try:
            out += blot_findings(img)
        except Exception:
            log.exception("blot checks failed")
    return out


# --- metadata of image files

# Software that edits images, by the first name that its tag holds; instruments'
# software, which is expected; colour profiles that editing leaves.
EDITORS = {
    "adobe photoshop": "Adobe Photoshop", "photoshop": "Adobe Photoshop", "gimp": "GIMP", "paint.net": "Paint.NET",
    "pixelmator": "Pixelmator", "affinity photo": "Affinity Photo", "corel": "CorelDRAW/Corel Photo-Paint", "paintshop": "PaintShop Pro",
    "photopea": "Photopea", "lightroom": "Adobe Lightroom", "capture one": "Capture One", "darktable": "darktable",
    "rawtherapee": "RawTherapee", "snapseed": "Snapseed", "imagemagick": "ImageMagick", "irfanview": "IrfanView",
}
INSTRUMENTS = "imagej|fiji|cellprofiler|metamorph|zeiss|leica|nikon|olympus|keyence|hamamatsu|biorad|bio-rad|chemidoc|licor|li-cor|azure biosystems|syngene|uvp".split("|")
EDITING_PROFILES = ("srgb iec61966-2.1", "adobe rgb (1998)", "prophoto rgb", "display p3")


def editing_software(software: Column) -> Column:
    """The name of the editor that made an image, null for none and for instruments' software."""
    tag = F.lower(software)
    instrument = F.exists(F.array(*map(F.lit, INSTRUMENTS)), lambda x: F.contains(tag, x))
    name = F.lit(None).cast("string")
    for part, editor in reversed(EDITORS.items()):
        name = F.when(F.contains(tag, F.lit(part)), F.lit(editor)).otherwise(name)
    return F.when(~instrument, name)


def profile_description(icc: Column) -> Column:
    """The text in a colour profile's description tag (100 bytes at most), else its size."""
    code = F.hex(icc)
    at = F.locate("64657363", code)
    first = (at - 1) / 2 + 12
    size = F.conv(F.substring(code, (at + 16).cast("int"), F.lit(8)), 16, 10).cast("long")
    text = F.substring(icc, (first + 1).cast("int"), F.least(size, F.lit(100)).cast("int"))
    plain = F.trim(F.regexp_replace(F.decode(text, "ISO-8859-1"), r"[^\x01-\x7F]", ""))
    return F.when(icc.isNull(), None).when(at > 0, plain).otherwise(F.concat(F.lit("ICC profile present ("), F.length(icc).cast("string"), F.lit(" bytes)")))


def has_xmp(content: Column) -> Column:
    """Whether the first 64 KB of a file hold an XMP packet."""
    return F.contains(F.lower(F.decode(F.substring(content, 1, 65536), "ISO-8859-1")), F.lit("xmp"))


def metadata_findings(files: DataFrame) -> DataFrame:
    """(figure_id, kind, severity, confidence) of files (figure_id, exif map, icc, content, bytes).

    Findings of a file are reported together, and only if one of them has a confidence over .5.
    """
    from probity.operators.text import exif_date_gap

    modified = F.try_element_at("exif", F.lit("DateTime"))
    made = F.coalesce(F.try_element_at("exif", F.lit("DateTimeOriginal")), modified)
    none = F.coalesce(F.size("exif"), F.lit(0)) <= 0
    profile = F.lower(profile_description(F.col("icc")))
    kinds = [
        ("editing_software", editing_software(F.try_element_at("exif", F.lit("Software"))).isNotNull(), "medium", 0.6),
        ("date_mismatch", exif_date_gap(made, modified) > 86400, "low", 0.4),
        ("icc_profile", F.exists(F.array(*map(F.lit, EDITING_PROFILES)), lambda x: F.contains(profile, x)), "low", 0.35),
        ("xmp_metadata", has_xmp(F.col("content")), "low", 0.3),
        ("stripped_metadata", none & (F.col("bytes") > 100_000), "low", 0.2),
    ]
    row = lambda k, s, c: F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.lit(c).alias("confidence"))
    found = F.array_compact(F.array(*[F.when(when, row(k, s, c)) for k, when, s, c in kinds]))
    shown = files.select("figure_id", found.alias("found")).filter(F.exists("found", lambda x: x["confidence"] > 0.5))
    return shown.select("figure_id", F.explode("found").alias("f")).select("figure_id", "f.*")


SCHEMA = "figure_id string, phash string, ahash string, method string, severity string, confidence double"


def screen_images(figures: DataFrame) -> DataFrame:
    """Hashes and findings of figures (figure_id, height, width, content, and blot where it is known
    that lanes are to be compared); a figure without findings has one row with null method. Images
    are decoded once and go through all checks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for f in frame.itertuples():
                img = np.frombuffer(f.content, np.uint8).reshape(f.height, f.width)
                found = findings_of(img, blot=bool(f.blot)) or [(None, None, None)]
                rows += [(f.figure_id, perceptual_hash(img), average_hash(img), *x) for x in found]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    blot = F.coalesce("blot", F.lit(False)) if "blot" in figures.columns else F.lit(False)
    return figures.select("figure_id", "height", "width", "content", blot.alias("blot")).mapInPandas(run, SCHEMA)
