"""Image kernels on NumPy arrays, for use inside tasks. No Spark here.

Images are float arrays (height, width) or (height, width, 3) from 0 to 1 unless said otherwise.
"""

from __future__ import annotations

import numpy as np


def per_channel(function, image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return function(image)
    return np.stack([function(image[..., c]) for c in range(image.shape[2])], axis=-1)


def luminance(image: np.ndarray) -> np.ndarray:
    image = np.asarray(image, np.float64)
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def luminance_many(images: np.ndarray) -> np.ndarray:
    """The luminance of a stack of images, of one or three channels."""
    images = np.asarray(images, np.float64)
    return images if images.ndim == 3 else images @ np.array([0.299, 0.587, 0.114])


def hsv(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in degrees, saturation and value of a colour image; hue and saturation are 0 where they have no meaning."""
    r, g, b = np.moveaxis(np.asarray(image, np.float64), -1, 0)
    high, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = high - low
    safe = np.where(span > 0, span, 1.0)
    sector = np.select([span == 0, high == r, high == g], [0.0, (g - b) / safe, 2 + (b - r) / safe], 4 + (r - g) / safe)
    hue = 60 * sector
    return np.where(hue < 0, hue + 360, hue), np.divide(span, high, out=np.zeros_like(high), where=high > 0), high


def gaussian_taps(sigma: float) -> np.ndarray:
    radius = int(4 * sigma + 0.5)
    x = np.arange(-radius, radius + 1)
    taps = np.exp(-(x**2) / (2.0 * sigma * sigma)) if sigma > 0 else np.ones(1)
    return taps / taps.sum()


def _smooth_axis(image: np.ndarray, taps: np.ndarray, axis: int, mode: str = "edge") -> np.ndarray:
    radius = len(taps) // 2
    pad = [(0, 0)] * image.ndim
    pad[axis] = (radius, radius)
    wide = np.moveaxis(np.pad(image, pad, mode=mode), axis, -1)
    n = image.shape[axis]
    if len(taps) <= 33:
        out = sum(t * wide[..., i : i + n] for i, t in enumerate(taps))
    else:  # long kernels by the convolution theorem
        size = 1 << (wide.shape[-1] + len(taps) - 1).bit_length()
        out = np.fft.irfft(np.fft.rfft(wide, size) * np.fft.rfft(taps, size), size)[..., 2 * radius : 2 * radius + n]
    return np.moveaxis(out, -1, axis)


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian smoothing; edges repeat the last pixel."""
    return _gaussian_many(np.asarray(image, np.float64)[None], sigma)[0]


def _gaussian_many(images: np.ndarray, sigma: float) -> np.ndarray:
    """The same for a stack of images, one after the other along the first axis."""
    taps = gaussian_taps(sigma)
    return _smooth_axis(_smooth_axis(images, taps, 1), taps, 2)


def laplacian(image: np.ndarray) -> np.ndarray:
    """The 3x3 Laplacian with diagonal weights 2 and centre -8; borders mirror without repeating the edge."""
    h, w = image.shape
    wide = np.pad(np.asarray(image, np.float64), ((1, 1), (0, 0)), mode="reflect" if h > 1 else "edge")
    wide = np.pad(wide, ((0, 0), (1, 1)), mode="reflect" if w > 1 else "edge")
    corners = wide[:-2, :-2] + wide[:-2, 2:] + wide[2:, :-2] + wide[2:, 2:]
    return 2.0 * corners - 8.0 * image


def focus(image: np.ndarray) -> float:
    return float(laplacian(image).var())


def noise_sigma(image: np.ndarray, sigma: float) -> float:
    rest = image - gaussian(image, sigma)
    return float(1.4826 * np.median(np.abs(rest - np.median(rest))))


def contrast(image: np.ndarray, low: float = 0.05, high: float = 0.95) -> float:
    a, b = np.percentile(image, [100 * low, 100 * high])
    return float(b - a)


def entropy(image: np.ndarray) -> float:
    """Shannon entropy in bits over distinct values."""
    counts = np.unique(image, return_counts=True)[1]
    p = counts / counts.sum()
    return float(abs(-(p * np.log2(p)).sum()))


def range_fraction(fit: np.ndarray, image_range: float) -> float:
    return float((fit.max() - fit.min()) / image_range) if image_range > 0 else 0.0


def _overlap_weights(n: int, m: int) -> np.ndarray:
    """m x n: how much of each of m equal parts of [0, n) each pixel covers."""
    edge = np.arange(m + 1) * (n / m)
    pixel = np.arange(n)
    cover = np.minimum(edge[1:, None], pixel + 1.0) - np.maximum(edge[:-1, None], pixel)
    cover = np.maximum(cover, 0)
    return cover / cover.sum(axis=1, keepdims=True)


def shrink(image: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Area-weighted reduction."""
    return _overlap_weights(image.shape[0], shape[0]) @ image @ _overlap_weights(image.shape[1], shape[1]).T


def _cubic_weights(n: int, m: int) -> np.ndarray:
    """m x n: cubic interpolation (a = -0.75) at half-pixel centres, edges repeated."""
    a = -0.75
    at = (np.arange(m) + 0.5) * n / m - 0.5
    base = np.floor(at).astype(int)
    out = np.zeros((m, n))
    for k in range(-1, 3):
        d = np.abs(at - (base + k))
        w = np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, np.where(d < 2, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a, 0.0))
        np.add.at(out, (np.arange(m), np.clip(base + k, 0, n - 1)), w)
    return out


def enlarge(image: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return _cubic_weights(image.shape[0], shape[0]) @ image @ _cubic_weights(image.shape[1], shape[1]).T


def rolling_ball(image: np.ndarray, radius: float) -> np.ndarray:
    """Background under a ball of that radius; outside the image is infinitely high."""
    r = int(radius)
    h, w = image.shape
    wide = np.pad(image, r, constant_values=np.inf)
    out = np.full((h, w), np.inf)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            d2 = dy * dy + dx * dx
            if d2 <= radius * radius:
                np.minimum(out, wide[r + dy : r + dy + h, r + dx : r + dx + w] + radius - np.sqrt(radius * radius - d2), out=out)
    return out


def background(channel: np.ndarray, radius: float, working_radius: float) -> np.ndarray:
    """A rolling-ball background from a reduced copy in which the ball has the working radius."""
    factor = max(1, int(np.rint(radius / working_radius)))
    if factor == 1:
        return rolling_ball(channel, radius)
    h, w = channel.shape
    small = shrink(channel, (max(1, int(np.rint(h / factor))), max(1, int(np.rint(w / factor)))))
    return enlarge(rolling_ball(small, max(1.0, radius / factor)), (h, w))


def flat_field(image: np.ndarray, radius: float, working_radius: float) -> np.ndarray:
    """Each channel over its background, stretched to 0 to 1 by itself (0 if it is constant)."""

    def one(channel: np.ndarray) -> np.ndarray:
        under = background(channel, radius, working_radius)
        out = channel / (under + 1e-6) * under.mean()
        low, high = out.min(), out.max()
        return (out - low) / (high - low) if high > low else np.zeros_like(out)

    return per_channel(one, np.asarray(image, np.float64))


def denoise(image: np.ndarray, patch: int, distance: int, h: float) -> np.ndarray:
    """Non-local means; the image itself if h is 0."""
    image = np.asarray(image, np.float64)
    if h <= 0:
        return image.copy()
    stack = image[..., None] if image.ndim == 2 else image
    half, rows, cols = patch // 2, *stack.shape[:2]
    margin = half + distance
    wide = np.pad(stack, ((margin, margin), (margin, margin), (0, 0)), mode="reflect" if min(rows, cols) > margin else "edge")
    total, weight = np.zeros_like(stack), np.zeros((rows, cols))
    inner = wide[distance : distance + rows + 2 * half, distance : distance + cols + 2 * half]
    for dy in range(-distance, distance + 1):
        for dx in range(-distance, distance + 1):
            moved = wide[distance + dy : distance + dy + rows + 2 * half, distance + dx : distance + dx + cols + 2 * half]
            square = ((inner - moved) ** 2).mean(axis=2)
            sums = np.zeros((square.shape[0] + 1, square.shape[1] + 1))
            sums[1:, 1:] = square.cumsum(axis=0).cumsum(axis=1)
            apart = (sums[patch:, patch:] - sums[:-patch, patch:] - sums[patch:, :-patch] + sums[:-patch, :-patch]) / (patch * patch)
            w = np.exp(-np.maximum(apart, 0) / (h * h))
            total += w[..., None] * moved[half : half + rows, half : half + cols]
            weight += w
    out = np.clip(total / weight[..., None], 0, 1)
    return out[..., 0] if image.ndim == 2 else out


def _equalise(gray: np.ndarray, kernel: int, clip: float, bins: int = 256) -> np.ndarray:
    h, w = gray.shape
    rows, cols = max(1, -(-h // kernel)), max(1, -(-w // kernel))
    level = np.minimum((gray * bins).astype(int), bins - 1)
    maps = np.empty((rows, cols, bins))
    for i in range(rows):
        for j in range(cols):
            block = level[i * h // rows : (i + 1) * h // rows, j * w // cols : (j + 1) * w // cols]
            hist = np.bincount(block.ravel(), minlength=bins).astype(float)
            limit = max(clip * block.size, 1.0)
            extra = np.maximum(hist - limit, 0).sum()
            hist = np.minimum(hist, limit) + extra / bins
            maps[i, j] = hist.cumsum() / hist.sum()
    y = np.clip((np.arange(h) + 0.5) * rows / h - 0.5, 0, rows - 1)
    x = np.clip((np.arange(w) + 0.5) * cols / w - 0.5, 0, cols - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, rows - 1), np.minimum(x0 + 1, cols - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: maps[a[:, None], b[None, :], level]
    return (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x1)) + fy * ((1 - fx) * at(y1, x0) + fx * at(y1, x1))


def clahe(image: np.ndarray, kernel: int, clip: float) -> np.ndarray:
    """Contrast-limited adaptive equalisation; of colour images, the brightness (greatest channel)."""
    image = np.clip(np.asarray(image, np.float64), 0, 1)
    if image.ndim == 2:
        return np.clip(_equalise(image, kernel, clip), 0, 1)
    bright = image.max(axis=2)
    factor = np.divide(_equalise(bright, kernel, clip), bright, out=np.zeros_like(bright), where=bright > 0)
    return np.clip(image * factor[..., None], 0, 1)


def _softened(edges: np.ndarray, sigma: float) -> np.ndarray:
    """A stack of edge maps, smoothed, the greatest of each 1."""
    soft = _gaussian_many(edges.astype(np.float64), sigma)
    top = soft.max(axis=(1, 2), keepdims=True)
    return np.clip(np.divide(soft, top, out=soft, where=top > 0), 0, 1).astype(np.float32)


#: Padding of a stack by one pixel around each image.
_RIM = ((0, 0), (1, 1), (1, 1))


def boundary_probability(labels: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Soft boundaries between regions: pixels whose cross-shaped neighbourhood has several labels, smoothed, greatest 1."""
    return _boundary_many(labels[None], sigma)[0]


def _boundary_many(labels: np.ndarray, sigma: float) -> np.ndarray:
    wide = np.pad(labels, _RIM, mode="edge")
    near = np.stack([wide[:, 1:-1, 1:-1], wide[:, :-2, 1:-1], wide[:, 2:, 1:-1], wide[:, 1:-1, :-2], wide[:, 1:-1, 2:]])
    return _softened(near.max(axis=0) != near.min(axis=0), sigma)


def gradient(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives along rows and columns, a quarter of the usual sums; also of a stack of images."""
    wide = np.pad(image, _RIM[-image.ndim :], mode="edge")
    dy = (wide[..., 2:, :-2] + 2 * wide[..., 2:, 1:-1] + wide[..., 2:, 2:] - wide[..., :-2, :-2] - 2 * wide[..., :-2, 1:-1] - wide[..., :-2, 2:]) / 4
    dx = (wide[..., :-2, 2:] + 2 * wide[..., 1:-1, 2:] + wide[..., 2:, 2:] - wide[..., :-2, :-2] - 2 * wide[..., 1:-1, :-2] - wide[..., 2:, :-2]) / 4
    return dy, dx


def _tall(images: np.ndarray, between) -> np.ndarray:
    """A stack as one image, its images below each other with a row between them: neighbours never cross it."""
    wide = np.pad(images, ((0, 0), (0, 1), (0, 0)), constant_values=between)
    return wide.reshape(-1, images.shape[2])


def _stack(tall: np.ndarray, n: int) -> np.ndarray:
    return tall.reshape(n, -1, tall.shape[1])[:, :-1]


def connected(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of 8-connected parts of a mask, in order of their first pixel; 0 elsewhere."""
    rows, cols = np.nonzero(mask)
    at = np.full((mask.shape[0] + 2, mask.shape[1] + 2), -1)
    at[rows + 1, cols + 1] = np.arange(len(rows))
    # each pixel's neighbours to the right and below, as links between pixels
    links = [(p, q) for p, q in ((np.arange(len(rows)), at[rows + 1 + v, cols + 1 + u]) for v, u in ((0, 1), (1, -1), (1, 0), (1, 1)))]
    a = np.concatenate([p[q >= 0] for p, q in links])
    b = np.concatenate([q[q >= 0] for _, q in links])
    root = np.arange(len(rows))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    out = np.zeros(mask.shape, np.int32)
    out[rows, cols] = np.unique(root, return_inverse=True)[1] + 1
    return out


_CROSS = ((-1, 0), (0, -1), (0, 1), (1, 0))
_AROUND = (*_CROSS, (-1, -1), (-1, 1), (1, -1), (1, 1))


def _jumped(points: np.ndarray) -> np.ndarray:
    """Where each pointer leads in the end."""
    while True:
        further = points[points]
        if np.array_equal(further, points):
            return points
        points = further


def _basins(image: np.ndarray, shifts: tuple, marked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Basins to which pixels run down among neighbours: each pixel's basin, the basins' lowest pixels, and the lowest pass of each pair that touches, by height.

    Marked pixels are basins of their own.
    """
    h, w = image.shape
    index = np.arange(image.size).reshape(h, w)
    wide = np.pad(image, 1, constant_values=np.inf)
    low, to = np.full((h, w), np.inf), index.copy()
    for v, u in shifts:
        near = wide[1 + v : 1 + v + h, 1 + u : 1 + u + w]
        better = near < low
        np.copyto(low, near, where=better)
        np.copyto(to, index + (v * w + u), where=better)
    falls = low < image
    if marked is not None:
        falls &= ~marked
    basin = _jumped(np.where(falls, to, index).ravel())
    roots = np.flatnonzero(basin == index.ravel())
    number = np.zeros(image.size, np.int64)
    number[roots] = np.arange(len(roots))
    grid = number[basin].reshape(h, w)
    pairs, heights = [], []
    for v, u in shifts:
        if (v, u) > (0, 0):  # each pair of neighbours once
            mine, other = (slice(v, None), slice(max(u, 0), w + min(u, 0))), (slice(0, h - v), slice(max(-u, 0), w - max(u, 0)))
            a, b = grid[mine], grid[other]
            apart = (a != b) & np.isfinite(image[mine]) & np.isfinite(image[other])  # heights without end part the images of a stack
            a, b = a[apart], b[apart]
            pairs.append(np.minimum(a, b) * len(roots) + np.maximum(a, b))
            heights.append(np.maximum(image[mine][apart], image[other][apart]))
    pair, height = np.concatenate(pairs), np.concatenate(heights)
    order = np.argsort(pair)
    pair, height = pair[order], height[order]
    start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(height, start) if len(pair) else height
    order = np.argsort(least)
    pair = pair[start][order]
    return grid, roots, pair // max(len(roots), 1), pair % max(len(roots), 1), least[order]


def fill_minima(image: np.ndarray, depth: float) -> np.ndarray:
    """Reconstruction by erosion of image + depth above the image, among 8 neighbours.

    A basin fills to its lowest point and depth, or to where it runs over into one that fills less: passes in order of height
    join basins, and what joins a part that is full by then is full at the pass.
    """
    image = np.ascontiguousarray(image, np.float64)
    grid, roots, a, b, height = _basins(image, _AROUND)
    level = image.ravel()[roots] + depth
    full = level.tolist()  # of a part, the level to which its least basin fills
    of, members = list(range(len(roots))), {}
    for p, q, x in zip(a.tolist(), b.tolist(), height.tolist(), strict=True):
        p, q = of[p], of[q]
        if p == q:
            continue
        mine, other = members.pop(p, None) or [p], members.pop(q, None) or [q]
        # what is open in the part that fills higher runs over into the other, at the pass or higher
        for some, own, less in ((mine, full[p], full[q]), (other, full[q], full[p])):
            if own > less and own > x:
                level[some] = np.minimum(level[some], max(x, less))
        if len(mine) < len(other):
            p, q, mine, other = q, p, other, mine
        for r in other:
            of[r] = p
        full[p] = min(full[p], full[q])
        members[p] = mine + other
    return np.maximum(image, level[grid])


def flood_levels(image: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """The least height over which a path leads to each pixel from a marked one; infinite without any.

    Pixels first run down to basins.  Between neighbouring basins the lowest pass counts, and passes in
    order of height join basins to those that hold a marker.
    """
    grid, roots, a, b, height = _basins(image, _CROSS, marked)
    heights = image.ravel()
    level = np.full(len(roots), np.inf)
    level[marked.ravel()[roots]] = heights[roots][marked.ravel()[roots]]
    known = np.isfinite(level).tolist()
    of, members = list(range(len(roots))), {}
    for p, q, x in zip(a.tolist(), b.tolist(), height.tolist(), strict=True):
        p, q = of[p], of[q]
        if p == q or (known[p] and known[q]):
            continue
        mine, other = members.pop(p, None) or [p], members.pop(q, None) or [q]
        if known[p] or known[q]:
            level[other if known[p] else mine] = x
        if len(mine) < len(other):
            p, q, mine, other = q, p, other, mine
        for r in other:
            of[r] = p
        known[p] = known[p] or known[q]
        members[p] = mine + other
    return np.maximum(image, level[grid])


def flood_in_order(image: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """The flood of watershed pixel by pixel.

    A pixel of the queue is one integer: the rank of its height, then its age, then its place in a
    grid with a border that counts as labelled.
    """
    from heapq import heapify, heappop, heappush, heappushpop

    row = image.shape[1] + 2
    rank = np.unique(image, return_inverse=True)[1].reshape(image.shape)
    bits = ((image.shape[0] + 2) * row).bit_length()
    place, step = (1 << bits) - 1, 1 << bits
    height = [r << (2 * bits) for r in np.pad(rank, 1).ravel().tolist()]
    label = np.pad(markers.astype(np.int32), 1, constant_values=-1).ravel().tolist()
    heap = [height[p] + i * step + p for i, p in enumerate(p for p, name in enumerate(label) if name > 0)]
    heapify(heap)
    age = len(heap) * step
    ahead = (-row, -1, 1, row)
    while heap:
        entry = heappop(heap)
        while entry is not None:  # the first pixel reached from this one is often the next of the queue
            p, entry = entry & place, None
            name, own = label[p], height[p]
            for shift in ahead:
                q = p + shift
                if not label[q]:
                    label[q] = name
                    high = height[q]
                    reached = (high if high > own else own) + age + q
                    age += step
                    if entry is None:
                        entry = reached
                    else:
                        heappush(heap, reached)
            if entry is not None:
                entry = heappushpop(heap, entry)
    return np.array(label, np.int32).reshape(-1, row)[1:-1, 1:-1].copy()


def watershed(image: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Regions that grow from markers in order of height; of equal heights, the pixel that was reached first.

    A pixel is flooded at the least height over which a path leads to it from a marker.  It takes the
    label of the neighbour that is flooded first, which is the lowest in this sense.  So each pixel points
    to a neighbour (in a basin that fills at one height, towards its inlet), and labels come by following
    the pointers to a marker.  Where lowest neighbours of different labels tie, which takes repeated
    heights, only the order of the whole flood decides, and that is followed pixel by pixel.
    """
    label, tied = _watershed_by_pointers(image, markers)
    return flood_in_order(image, markers) if tied.any() else label


def _watershed_by_pointers(image: np.ndarray, markers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels, and the pixels at which lowest neighbours of different labels tie."""
    h, w = image.shape
    level = flood_levels(image, markers > 0)
    wide = np.pad(level, 1, constant_values=np.inf).ravel()
    row = w + 2
    inside = (np.arange(h)[:, None] * row + row + 1 + np.arange(w)).ravel()
    marked = np.zeros(len(wide), bool)
    marked[inside] = markers.ravel() > 0
    shifts = [v * row + u for v, u in _CROSS]
    near = np.stack([wide[inside + s] for s in shifts])
    own = wide[inside]
    # steps from a marker or from an inlet, a pixel with a lower neighbour, among pixels that fill at one height
    steps = np.full(len(wide), np.iinfo(np.int32).max, np.int32)
    front, count = np.concatenate([np.flatnonzero(marked), inside[(near.min(axis=0) < own) & ~marked[inside] & np.isfinite(own)]]), 0
    steps[front] = 0
    step = np.array(shifts)[:, None]
    seen = np.zeros(len(wide), np.int64)
    while len(front):
        count += 1
        around = (front + step).ravel()
        around = around[(wide[around].reshape(len(shifts), -1) == wide[front]).ravel() & (steps[around] > count)]
        steps[around] = count
        seen[around] = np.arange(len(around))
        front = around[seen[around] == np.arange(len(around))]  # each once
    # of the neighbours, the least (height, steps)
    best, parent = np.full(len(inside), np.inf), inside.copy()
    best_steps = np.full(len(inside), np.iinfo(np.int32).max, np.int32)
    for s, x in zip(shifts, near, strict=True):
        n = steps[inside + s]
        first = (x < best) | ((x == best) & (n < best_steps))
        best[first], best_steps[first], parent[first] = x[first], n[first], (inside + s)[first]
    points = np.arange(len(wide))
    points[inside] = np.where(marked[inside] | ~np.isfinite(own), inside, parent)
    points = _jumped(points)
    label = np.zeros(len(wide), np.int32)
    label[inside] = markers.ravel()
    label = label[points]
    open_ = ~marked[inside] & np.isfinite(own)
    tied = np.zeros(len(inside), bool)
    for shift, x in zip(shifts, near, strict=True):
        tied |= open_ & (x == best) & (label[inside + shift] != label[inside])
    return label[inside].reshape(h, w), tied.reshape(h, w)


def drop_small(label: np.ndarray, least: int) -> np.ndarray:
    size = np.bincount(label.ravel())
    small = size < least
    small[0] = False
    return np.where(small[label], 0, label).astype(np.int32)


def score_watershed(image: np.ndarray, sigma: float, depth: float, least_area: int, boundary_sigma: float = 1.0) -> np.ndarray:
    """Boundary probability from watershed regions of the smoothed gradient."""
    return score_watershed_many(image[None], sigma, depth, least_area, boundary_sigma)[0]


def score_watershed_many(images: np.ndarray, sigma: float, depth: float, least_area: int, boundary_sigma: float = 1.0) -> np.ndarray:
    """The same for a stack of images of one shape; each has the result that it has alone."""
    n = len(images)
    dy, dx = gradient(_gaussian_many(luminance_many(images), sigma))
    steep = np.round(np.hypot(dy, dx) / np.sqrt(2.0), 12)
    tall = _tall(steep, np.inf)
    deep = _stack(fill_minima(tall, depth), n) - steep >= depth - 1e-12
    markers = connected(_tall(deep, False))
    label, tied = _watershed_by_pointers(tall, markers)
    label = _stack(label, n).copy()
    for i in np.flatnonzero(_stack(tied, n).any(axis=(1, 2))):
        label[i] = flood_in_order(steep[i], _stack(markers, n)[i])
    return _boundary_many(drop_small(label, least_area), boundary_sigma)


def canny(image: np.ndarray, sigma: float, low: float, high: float) -> np.ndarray:
    """Edges: ridges of the smoothed gradient (plain Sobel sums) of at least low, in 8-connected parts that reach high.

    A pixel is on a ridge if its gradient is no less than those ahead and behind, which are interpolated
    between the two neighbours that the direction passes between.  The outermost pixels are no edges, and
    smoothing looks at pixels of the image alone.
    """
    return canny_many(np.asarray(image)[None], sigma, np.array([low]), np.array([high]))[0]


def canny_many(images: np.ndarray, sigma: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The same for a stack of gray images with a low and a high threshold each."""
    taps = gaussian_taps(sigma)
    blank = lambda a: _smooth_axis(_smooth_axis(a, taps, 1, "constant"), taps, 2, "constant")
    inner = np.ones((1, *images.shape[1:]))
    dy, dx = (4 * g for g in gradient(blank(images) / (blank(inner) + np.finfo(float).eps)))
    steep = np.hypot(dy, dx)
    n, h, w = steep.shape
    wide = np.pad(steep, _RIM).ravel()
    row = w + 2
    ay, ax = np.abs(dy), np.abs(dx)
    flat = ax >= ay
    share = np.divide(np.minimum(ay, ax), np.maximum(ay, ax), out=np.zeros_like(steep), where=steep > 0)
    v, u = np.where(dy < 0, -row, row), np.where(dx < 0, -1, 1)
    straight, slanting = np.where(flat, u, v), v + u
    at = np.arange(n * (h + 2) * row).reshape(n, h + 2, row)[:, 1:-1, 1:-1]
    ridge = np.zeros(steep.shape, bool)
    ridge[:, 1:-1, 1:-1] = True
    for way in (1, -1):
        # equal gradients stay on the ridge, whatever rounding makes of them
        ridge &= (1 - share) * wide[at + way * straight] + share * wide[at + way * slanting] <= steep + 1e-9
    weak = ridge & (steep >= low[:, None, None]) & (steep > 0)
    part = _stack(connected(_tall(weak, False)), n)
    reaches = np.zeros(part.max(initial=0) + 1, bool)
    reaches[part[weak & (steep >= high[:, None, None])]] = True
    reaches[0] = False
    return reaches[part]


def score_canny(image: np.ndarray, sigma: float, low: float = 60.0, high: float = 90.0) -> np.ndarray:
    """Soft edges: Canny with thresholds at percentiles of the luminance, smoothed, greatest 1."""
    return score_canny_many(image[None], sigma, low, high)[0]


def score_canny_many(images: np.ndarray, sigma: float, low: float = 60.0, high: float = 90.0) -> np.ndarray:
    """The same for a stack of images of one shape; each has the result that it has alone."""
    gray = luminance_many(images)
    a, b = np.percentile(gray.reshape(len(gray), -1), [low, high], axis=1)
    return _softened(canny_many(gray, sigma, a, b), 1.0)


def border_crop(gray: np.ndarray, ratio: float, fraction: float) -> tuple[int, int, int, int, bool]:
    """Rows and columns of nearly constant level at each edge: (top, bottom, left, right, capped)."""

    def runs(variance: np.ndarray) -> tuple[int, int, bool]:
        uniform = variance <= np.median(variance) * ratio
        n = len(variance)
        cap = int(n * fraction)
        ahead = n if uniform.all() else int(np.argmin(uniform))
        behind = n if uniform.all() else int(np.argmin(uniform[::-1]))
        return min(ahead, cap), min(behind, cap), 0 < cap <= max(ahead, behind)

    gray = np.asarray(gray, np.float64)
    top, bottom, capped_rows = runs(gray.var(axis=1))
    left, right, capped_cols = runs(gray.var(axis=0))
    return top, bottom, left, right, capped_rows or capped_cols
