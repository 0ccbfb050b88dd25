"""Kernels on blocks of grey images, arrays of shape (images, rows, columns). No loops over pixels, and no Spark."""

from __future__ import annotations

import numpy as np

F10 = ("mean", "std", "area_ratio", "glcm_contrast", "glcm_homogeneity", "glcm_energy", "glcm_correlation", "compactness", "skewness", "kurtosis")
F13 = (*F10, "lbp_entropy", "gradient_mean", "local_entropy")
D10 = ("mean", "std", "skew", "kurt", "entropy", "tumor_area", "tumor_mean", "compactness", "gradient", "homogeneity")
#: Neighbour offsets of the co-occurrence angles 0, 45, 90 and 135 degrees.
OFFSETS = ((0, 1), (1, 1), (1, 0), (1, -1))


def _padded(x: np.ndarray, width: int, mode: str) -> np.ndarray:
    return np.pad(x, ((0, 0), (width, width), (width, width)), mode=mode)


def _shifts(x: np.ndarray, width: int, mode: str):
    """(dy, dx, x moved by that), with the border filled as mode says."""
    padded, (_, h, w) = _padded(x, width, mode), x.shape
    for dy in range(-width, width + 1):
        for dx in range(-width, width + 1):
            yield dy, dx, padded[:, width + dy : width + dy + h, width + dx : width + dx + w]


def correlate(x: np.ndarray, kernel: np.ndarray, mode: str = "symmetric") -> np.ndarray:
    width = len(kernel) // 2
    out = np.zeros(x.shape)
    for dy, dx, moved in _shifts(x.astype(float), width, mode):
        if kernel[width + dy, width + dx]:
            out += kernel[width + dy, width + dx] * moved
    return out


def gaussian_kernel(size: int = 5, sigma: float = 1.4) -> np.ndarray:
    line = np.exp(-(np.arange(-(size // 2), size // 2 + 1) ** 2) / (2 * sigma**2))
    return np.outer(line, line) / line.sum() ** 2


def blur(x: np.ndarray, mode: str = "reflect") -> np.ndarray:
    """Gaussian, cut to 0..255 and to whole levels; the tiny addend makes flat patches keep their level."""
    return np.floor(np.clip(correlate(x, gaussian_kernel(), mode), 0, 255) + 1e-9).astype(np.uint8)


def histograms(x: np.ndarray, levels: int = 256) -> np.ndarray:
    n = len(x)
    flat = x.reshape(n, -1).astype(np.int64) + np.arange(n)[:, None] * levels
    return np.bincount(flat.ravel(), minlength=n * levels).reshape(n, levels)


def equalize_hist(x: np.ndarray) -> np.ndarray:
    """Levels by cumulative share; a constant image becomes 0."""
    cdf = np.cumsum(histograms(x), axis=1)
    size = x[0].size
    low = np.where(cdf > 0, cdf, size).min(axis=1, keepdims=True)
    table = np.round(np.maximum(cdf - low, 0) / np.maximum(size - low, 1) * 255).astype(np.uint8)
    return np.take_along_axis(table, x.reshape(len(x), -1).astype(np.int64), axis=1).reshape(x.shape)


def normalize(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    low, high = x.min(axis=(1, 2), keepdims=True), x.max(axis=(1, 2), keepdims=True)
    return (x - low) / (high - low + 1e-8)


def preprocess(x: np.ndarray, mode: str = "reflect") -> np.ndarray:
    return normalize(equalize_hist(blur(x, mode)))


def otsu_threshold(x: np.ndarray) -> np.ndarray:
    """Of normalised images: the first level of the largest variance between classes, over 255; 0 if there is none. Levels
    of one variance differ in their last bits, so variances are compared to six digits, and to fourteen places in all."""
    counts = histograms((x * 255).astype(np.uint8)).astype(float)
    below, total = np.cumsum(counts, axis=1), x[0].size
    sums = np.cumsum(counts * np.arange(256), axis=1)
    above = total - below
    valid = (below > 0) & (above > 0)
    apart = sums / np.where(below > 0, below, 1) - (sums[:, -1:] - sums) / np.where(above > 0, above, 1)
    spread = np.where(valid, np.floor(below * above * apart * apart * 1e6 + 0.5) / 1e6, -1)
    largest = spread.max(axis=1, keepdims=True)
    return np.where(valid.any(axis=1), (spread >= largest * (1 - 1e-14)).argmax(axis=1), 0) / 255.0


def erode(mask: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = np.logical_and.reduce([m for _, _, m in _shifts(mask, 1, "constant")])
    return mask


def dilate(mask: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = np.logical_or.reduce([m for _, _, m in _shifts(mask, 1, "constant")])
    return mask


def component_labels(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Each set pixel's least flat index among its component's pixels; -1 elsewhere. Neighbours pass on their least
    index and pixels then jump to their label's label, so long snakes take few rounds."""
    size = mask.size
    labels = np.where(mask, np.arange(size).reshape(mask.shape), size)
    while True:
        least = labels
        for dy, dx, moved in _shifts_of_labels(labels, size):
            if diagonal or not (dy and dx):
                least = np.minimum(least, moved)
        least = np.where(mask, least, size)
        jumped = np.append(least.ravel(), size)[least]
        if (jumped == labels).all():
            return np.where(mask, labels, -1)
        labels = jumped


def _shifts_of_labels(labels: np.ndarray, outside: int):
    padded, (_, h, w) = np.pad(labels, ((0, 0), (1, 1), (1, 1)), constant_values=outside), labels.shape
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            yield dy, dx, padded[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]


def component_sizes(labels: np.ndarray) -> np.ndarray:
    """At each set pixel the size of its component, 0 elsewhere."""
    counts = np.bincount(labels[labels >= 0], minlength=labels.size + 1)
    return np.where(labels >= 0, counts[labels], 0)


def largest_component(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """The largest component of each image, the first in row order of equal ones."""
    labels = component_labels(mask, diagonal)
    sizes = component_sizes(labels)
    flat = sizes.reshape(len(mask), -1)
    first = np.take_along_axis(labels.reshape(len(mask), -1), flat.argmax(axis=1)[:, None], axis=1)
    return (labels == first[:, :, None]) & mask


def segment_stages(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of normalised images: the masks after threshold, erosion, choice of the largest component, and dilation."""
    bar = np.maximum(otsu_threshold(x), 0.88 * np.percentile(x.reshape(len(x), -1), 82, axis=1))
    binary = x > bar[:, None, None]
    eroded = erode(binary, 1)
    component = largest_component(eroded)
    return binary, eroded, component, dilate(component, 2)


def quality_score(x: np.ndarray) -> np.ndarray:
    """Of raw images: sharpness plus contrast less distance from medium brightness."""
    edges = correlate(x, np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float))
    return edges.var(axis=(1, 2)) + x.std(axis=(1, 2)) - np.abs(x.mean(axis=(1, 2)) - 128)


def glcm_features(levels: np.ndarray) -> tuple[float, float, float, float]:
    """Contrast, homogeneity, energy and correlation of one image's levels: means over the four angles of the symmetric,
    normalised co-occurrences at distance 1. The pairs are listed, not put in a matrix."""
    x = levels.astype(np.int64)
    h, w = x.shape
    out = []
    for dy, dx in OFFSETS:
        a = x[: h - dy, max(0, -dx) : w - max(0, dx)].ravel()
        b = x[dy:, max(0, dx) : w - max(0, -dx)].ravel()
        if not a.size:
            out.append((0.0, 0.0, 0.0, 1.0))
            continue
        apart = (a - b) ** 2
        codes = np.concatenate((a * 256 + b, b * 256 + a))
        shares = np.unique(codes, return_counts=True)[1] / codes.size
        middle = (a.sum() + b.sum()) / codes.size
        spread = (((a - middle) ** 2).sum() + ((b - middle) ** 2).sum()) / codes.size
        together = ((a - middle) * (b - middle)).mean()
        out.append((apart.mean(), (1 / (1 + apart)).mean(), np.sqrt((shares**2).sum()), 1.0 if spread < 1e-15 else together / spread))
    return tuple(float(v) for v in np.mean(out, axis=0))


def moments(pixels: np.ndarray, eps: float) -> tuple[float, float, float, float]:
    """Mean, deviation + eps, skewness and (plain) kurtosis."""
    mean, std = pixels.mean(), pixels.std() + eps
    diff = pixels - mean
    return float(mean), float(std), float((diff**3).mean() / std**3), float((diff**4).mean() / std**4)


def _cross_eroded(mask: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([m for dy, dx, m in _shifts(mask, 1, "constant") if not (dy and dx)])


def border_compactness(mask: np.ndarray) -> np.ndarray:
    """Squared number of border pixels over area."""
    border = (mask & ~_cross_eroded(mask)).sum(axis=(1, 2))
    return border**2 / (mask.sum(axis=(1, 2)) + 1e-5)


def weighted_perimeter(mask: np.ndarray) -> np.ndarray:
    """Border pixels weighted by how they meet their neighbours: straight 1, diagonal sqrt 2, corners the mean of both
    (the perimeter estimator of Benkrid and Crookes 2000)."""
    border = (mask & ~_cross_eroded(mask)).astype(int)
    code = sum({0: 1, 1: 2, 2: 10}[abs(dy) + abs(dx)] * m for dy, dx, m in _shifts(border, 1, "constant"))
    weights = np.zeros(50)
    weights[[5, 7, 15, 17, 25, 27]], weights[[21, 33]], weights[[13, 23]] = 1, np.sqrt(2), (1 + np.sqrt(2)) / 2
    return weights[code].sum(axis=(1, 2))


def edge_compactness(mask: np.ndarray) -> np.ndarray:
    """Squared number of exposed pixel edges over area."""
    exposed = sum((mask & ~m).sum(axis=(1, 2)) for dy, dx, m in _shifts(mask, 1, "constant") if abs(dy) + abs(dx) == 1)
    return exposed**2 / (mask.sum(axis=(1, 2)) + 1e-8)


def lbp_codes(x: np.ndarray) -> np.ndarray:
    """Which of the 8 neighbours, clockwise from the upper left, are at least as bright; 0 on the border."""
    x8 = (x * 255).astype(np.uint8)
    codes = np.zeros(x.shape, np.uint8)
    if min(x.shape[1:]) < 3:
        return codes
    inner = x8[:, 1:-1, 1:-1]
    _, h, w = x.shape
    # fixed values: the neighbours' order is that of the code's bits
    for bit, (dy, dx) in enumerate(((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))):
        codes[:, 1:-1, 1:-1] |= (x8[:, 1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] >= inner).astype(np.uint8) << bit
    return codes


def _entropy(counts: np.ndarray) -> np.ndarray:
    p = counts / (counts.sum(axis=-1, keepdims=True) + 1e-8)
    return -np.where(p > 0, p * np.log2(p + 1e-8), 0).sum(axis=-1)


def lbp(x: np.ndarray) -> np.ndarray:
    """Mean, deviation, energy and entropy of the codes' histogram; one row per image."""
    counts = histograms(lbp_codes(x)).astype(float)
    p = counts / (counts.sum(axis=1, keepdims=True) + 1e-8)
    bins = np.arange(256)
    mean = (bins * p).sum(axis=1)
    return np.stack((mean, np.sqrt(((bins - mean[:, None]) ** 2 * p).sum(axis=1)), (p**2).sum(axis=1), _entropy(counts)), axis=1)


def gradient(x: np.ndarray) -> np.ndarray:
    """Mean, deviation and maximum of the Sobel magnitude; one row per image."""
    across = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)  # fixed values: Sobel's weights
    size = np.hypot(correlate(x, across), correlate(x, across.T))
    return np.stack((size.mean(axis=(1, 2)), size.std(axis=(1, 2)), size.max(axis=(1, 2))), axis=1)


def local_entropy(pixels: np.ndarray) -> float:
    return float(_entropy(np.bincount((pixels * 255).astype(np.uint8), minlength=256).astype(float))) if pixels.size >= 4 else 0.0


def bounding_box(mask: np.ndarray) -> tuple[int, int, int, int]:
    """(y0, x0, y1, x1) of one mask, ends exclusive; all 0 if it is empty."""
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return (int(rows[0]), int(columns[0]), int(rows[-1]) + 1, int(columns[-1]) + 1) if rows.size else (0, 0, 0, 0)


def features_f10(x: np.ndarray) -> np.ndarray:
    """Of normalised images, one row each; an empty region becomes the whole image."""
    masks = segment_stages(x)[3]
    masks = np.where(masks.any(axis=(1, 2), keepdims=True), masks, True)
    compact, rows = border_compactness(masks), []
    for image, mask, c in zip(x, masks, compact, strict=True):
        y0, x0, y1, x1 = bounding_box(mask)
        crop = image[y0:y1, x0:x1]
        mean, std, skew, kurt = moments(image[mask], 1e-5)
        levels = ((crop - crop.min()) / (crop.max() - crop.min() + 1e-8) * 255).astype(np.uint8)
        rows.append((mean, std, mask.mean(), *glcm_features(levels), c, skew, kurt))
    return np.array(rows, float).reshape(len(x), len(F10))


def _disk(radius: int) -> np.ndarray:
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    return x * x + y * y <= radius * radius


def _over_disk(x: np.ndarray, radius: int, mode: str, reduce) -> np.ndarray:
    disk = _disk(radius)
    return reduce([m for dy, dx, m in _shifts(x, radius, mode) if disk[radius + dy, radius + dx]])


def chan_vese(x: np.ndarray, mu: float = 0.2, tol: float = 1e-3, max_iter: int = 200, dt: float = 0.5) -> np.ndarray:
    """Two-region level sets without edges (Chan and Vese 2001, in the semi-implicit scheme of Getreuer 2012), all images
    at once; an image stops when its level set moves less than tol."""
    _, h, w = x.shape
    rows, columns = np.mgrid[:h, :w]
    level = np.broadcast_to(np.sin(np.pi / 5 * rows) * np.sin(np.pi / 5 * columns), x.shape).copy()
    active = np.arange(len(x))
    for _ in range(max_iter):
        if not active.size:
            break
        phi, image = level[active], x[active]
        inside = phi > 0
        n_in, n_out = inside.sum(axis=(1, 2)), (~inside).sum(axis=(1, 2))
        c_in = (image * inside).sum(axis=(1, 2)) / np.maximum(n_in, 1)
        c_out = (image * ~inside).sum(axis=(1, 2)) / np.maximum(n_out, 1)
        p = _padded(phi, 1, "edge")
        east, west, south, north, here = p[:, 1:-1, 2:], p[:, 1:-1, :-2], p[:, 2:, 1:-1], p[:, :-2, 1:-1], phi
        eta = 1e-16
        c1 = 1 / np.sqrt(eta + (east - here) ** 2 + ((south - north) / 2) ** 2)
        c2 = 1 / np.sqrt(eta + (here - west) ** 2 + ((south - north) / 2) ** 2)
        c3 = 1 / np.sqrt(eta + ((east - west) / 2) ** 2 + (south - here) ** 2)
        c4 = 1 / np.sqrt(eta + ((east - west) / 2) ** 2 + (here - north) ** 2)
        curved = east * c1 + west * c2 + south * c3 + north * c4
        fit = -((image - c_in[:, None, None]) ** 2) + (image - c_out[:, None, None]) ** 2
        delta = 1 / (np.pi * (1 + phi**2))
        new = (phi + dt * delta * (mu * curved + fit)) / (1 + mu * dt * delta * (c1 + c2 + c3 + c4))
        moved = np.sqrt(((new - phi) ** 2).mean(axis=(1, 2)))
        level[active] = new
        active = active[moved > tol]
    return level > 0


def segment_chan_vese(x: np.ndarray, least: int = 300) -> np.ndarray:
    """Of normalised images: stretched, smoothed by a median, split in two regions; small objects go, gaps close and the
    largest region, diagonals counted, stays."""
    low, high = x.min(axis=(1, 2), keepdims=True), x.max(axis=(1, 2), keepdims=True)
    smooth = _over_disk((x - low) / np.where(high > low, high - low, 1), 3, "edge", lambda m: np.median(np.stack(m), axis=0))
    mask = chan_vese(smooth)
    mask &= component_sizes(component_labels(mask)) >= least
    mask = _over_disk(mask, 3, "constant", np.logical_or.reduce)
    mask = ~_over_disk(~mask, 3, "constant", np.logical_or.reduce)
    return largest_component(mask, diagonal=True)


def features_f13(x: np.ndarray, least: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Of normalised images: a row for each valid one, and which are valid: at least 16 pixels and some spread. least: pixels of the
    smallest object that counts."""
    masks = segment_chan_vese(x, least)
    perimeters, entropies, gradients, rows, valid = weighted_perimeter(masks), lbp(x)[:, 3], gradient(x)[:, 0], [], np.zeros(len(x), bool)
    for i, (image, mask) in enumerate(zip(x, masks, strict=True)):
        area = int(mask.sum())
        if area < 16:
            continue
        low, high = np.percentile(image[mask], (1, 99))
        if high - low < 1e-8:
            continue
        y0, x0, y1, x1 = bounding_box(mask)
        levels = ((np.clip(image[y0:y1, x0:x1], low, high) - low) / (high - low + 1e-8) * 31).astype(np.uint8)
        mean, std, skew, kurt = moments(np.clip(image[mask], low, high), 1e-8)
        rows.append((mean, std, area / mask.size, *glcm_features(levels), 4 * np.pi * area / (perimeters[i] ** 2 + 1e-8), skew, kurt, entropies[i], gradients[i], local_entropy(image[mask])))
        valid[i] = True
    return np.array(rows, float).reshape(-1, len(F13)), valid


def features_d10(x: np.ndarray) -> np.ndarray:
    """Of normalised images: the feature table's columns, kurtosis in excess of 3."""
    masks, flat = segment_stages(x)[3], x.reshape(len(x), -1)
    mean, std = flat.mean(axis=1), flat.std(axis=1) + 1e-8
    diff = flat - mean[:, None]
    p = histograms(np.minimum((x * 32).astype(np.int64), 31), 32) / (flat.shape[1] + 1e-8)
    area = masks.sum(axis=(1, 2))
    inside = np.where(area > 0, (x * masks).sum(axis=(1, 2)) / np.maximum(area, 1), 0.0)
    steps = (np.abs(np.diff(x, axis=1)).mean(axis=(1, 2)) + np.abs(np.diff(x, axis=2)).mean(axis=(1, 2))) / 2
    return np.stack((mean, std, (diff**3).mean(axis=1) / std**3, (diff**4).mean(axis=1) / std**4 - 3, -(p * np.log2(p + 1e-10)).sum(axis=1), area / flat.shape[1], inside, edge_compactness(masks), steps, 1 - np.abs(x[:, 1:, 1:] - x[:, :-1, :-1]).mean(axis=(1, 2))), axis=1)


def brain_mask(x: np.ndarray) -> np.ndarray:
    """Tissue that isn't background (what reaches the border), eroded 6 times, or 3 if little is left."""
    tissue = x > 0.10
    framed = np.pad(~tissue, ((0, 0), (1, 1), (1, 1)), constant_values=True)
    labels = component_labels(framed)
    head = tissue & ~(labels == labels[:, :1, :1])[:, 1:-1, 1:-1]
    brain = erode(head, 6)
    return np.where((brain.sum(axis=(1, 2)) < 200)[:, None, None], erode(head, 3), brain)


def overlay(x: np.ndarray, mask: np.ndarray, colour: tuple[int, int, int] = (255, 0, 0), strength: float = 0.5) -> np.ndarray:
    """RGB planes of one normalised image with the mask in colour, for previews."""
    grey = np.repeat((x * 255).astype(np.uint8)[:, :, None], 3, axis=2)
    return np.where(mask[:, :, None], (grey * (1 - strength) + np.array(colour) * strength).astype(np.uint8), grey)


def luma(bgr: np.ndarray) -> np.ndarray:
    """Grey levels of blue-green-red(-alpha) planes, last axis channels."""
    b, g, r = (bgr[..., i].astype(np.int64) for i in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + 32768) >> 16).astype(np.uint8)


def _resize_weights(source: int, target: int) -> np.ndarray:
    """Antialiased bicubic weights (Keys, a = -0.5), one row per target pixel."""
    scale = source / target
    stretch = max(scale, 1.0)
    centers = (np.arange(target) + 0.5) * scale
    d = np.abs((np.arange(source)[None, :] + 0.5 - centers[:, None]) / stretch)
    a = -0.5
    w = np.where(d < 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, np.where(d < 2, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a, 0))
    return w / w.sum(axis=1, keepdims=True)


def resize(x: np.ndarray, size: int = 128) -> np.ndarray:
    """One grey image to size x size, rounded to levels after each direction."""
    if x.shape == (size, size):
        return x
    levels = lambda v: np.clip(np.floor(v + 0.5), 0, 255)
    across = levels(x.astype(float) @ _resize_weights(x.shape[1], size).T)
    return levels(_resize_weights(x.shape[0], size) @ across).astype(np.uint8)
