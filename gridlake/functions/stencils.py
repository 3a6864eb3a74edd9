"""Neighbourhood filters on stacks of images: arrays (n, rows, cols), borders mirrored without the edge."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def padded(a: np.ndarray, top: int, left: int, bottom: int, right: int, mode: str = "reflect", value: float = 0.0) -> np.ndarray:
    width = ((0, 0), (top, bottom), (left, right))
    return np.pad(a, width, mode="constant", constant_values=value) if mode == "constant" else np.pad(a, width, mode=mode)


def shifts(a: np.ndarray, rows: int, cols: int, mode: str = "reflect", value: float = 0.0):
    """For each cell (i, j) of a rows x cols window around rows // 2, cols // 2: i, j, the shifted stack."""
    p = padded(a, rows // 2, cols // 2, rows - 1 - rows // 2, cols - 1 - cols // 2, mode, value)
    for i in range(rows):
        for j in range(cols):
            yield i, j, p[:, i : i + a.shape[1], j : j + a.shape[2]]


def correlate(a: np.ndarray, kernel, mode: str = "reflect") -> np.ndarray:
    k = np.asarray(kernel, float)
    out = np.zeros(a.shape)
    for i, j, s in shifts(a, *k.shape, mode):
        if k[i, j]:
            out += k[i, j] * s
    return out


def separable(a: np.ndarray, row_kernel, col_kernel) -> np.ndarray:
    return correlate(correlate(a, [list(row_kernel)]), [[w] for w in col_kernel])


def gaussian_weights(size: int, sigma: float) -> np.ndarray:
    if size <= 0:
        size = round(6 * sigma + 1) | 1
    x = np.arange(size) - (size - 1) / 2
    w = np.exp(-(x**2) / (2 * sigma * sigma))
    return w / w.sum()


def gaussian(a: np.ndarray, size: int, sigma: float) -> np.ndarray:
    w = gaussian_weights(size, sigma)
    return separable(a, w, w)


def recursive_gaussian(a: np.ndarray, sigma: float, pad: int) -> np.ndarray:
    """Third-order recursive Gaussian, forwards then backwards, over rows and then columns. The row is
    mirrored with its edge sample repeated, pad samples (three or more) at both ends; the way forward starts
    from zeros, the way back from the last three values of the way forward, which it leaves as they are."""
    if sigma < 0.5:
        q = 0.1147705
    else:
        q = 0.98711 * sigma - 0.96330 if sigma >= 2.5 else 3.97156 - 4.14554 * np.sqrt(1 - 0.26891 * sigma)
    b0 = 1.57825 + 2.44413 * q + 1.4281 * q**2 + 0.422205 * q**3
    b1 = (2.44413 * q + 2.85619 * q**2 + 1.26661 * q**3) / b0
    b2 = -(1.4281 * q**2 + 1.26661 * q**3) / b0
    b3 = 0.422205 * q**3 / b0
    gain = 1 - (b1 + b2 + b3)

    def filtered(x: np.ndarray, state: list) -> np.ndarray:
        """x along its last axis after the three outputs of state, the newest first."""
        y = np.empty_like(x)
        p1, p2, p3 = state
        for i in range(x.shape[-1]):
            y[..., i] = gain * x[..., i] + b1 * p1 + b2 * p2 + b3 * p3
            p1, p2, p3 = y[..., i], p1, p2
        return y

    def along(x: np.ndarray) -> np.ndarray:
        n = x.shape[-1]
        w = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(pad, pad)], mode="symmetric")
        back = filtered(w, [0.0] * 3)[..., ::-1]
        back = filtered(back[..., 3:], [back[..., 2], back[..., 1], back[..., 0]])
        return back[..., pad - 3 : pad - 3 + n][..., ::-1]

    return along(along(a.astype(float)).swapaxes(1, 2)).swapaxes(1, 2)


def box(a: np.ndarray, size_x: int, size_y: int) -> np.ndarray:
    return separable(a, np.full(size_x, 1 / size_x), np.full(size_y, 1 / size_y))


def derivative_weights(order: int, size: int) -> np.ndarray:
    """Binomial smoothing with as many differences as the order."""
    w = np.ones(1)
    for _ in range(size - order - 1):
        w = np.convolve(w, [1, 1])
    for _ in range(order):
        w = np.convolve(w, [-1, 1])
    return w


def sobel(a: np.ndarray, dx: int, dy: int, size: int) -> np.ndarray:
    return separable(a, derivative_weights(dx, size), derivative_weights(dy, size))


LAPLACIANS = (
    ((0, 1, 0), (1, -4, 1), (0, 1, 0)),
    ((2, 0, 2), (0, -8, 0), (2, 0, 2)),
    ((-1, -3, -4, -3, -1), (-3, 0, 6, 0, -3), (-4, 6, 20, 6, -4), (-3, 0, 6, 0, -3), (-1, -3, -4, -3, -1)),
    ((-2, -4, -4, -4, -2), (-4, 0, 8, 0, -4), (-4, 8, 24, 8, -4), (-4, 0, 8, 0, -4), (-2, -4, -4, -4, -2)),
)


def laplacian(a: np.ndarray, index: int) -> np.ndarray:
    return correlate(a, LAPLACIANS[index])


def neighbourhood(a: np.ndarray, rows: int, cols: int, fn: Callable[[np.ndarray], np.ndarray], mode: str = "reflect", value: float = 0.0) -> np.ndarray:
    """fn gets windows (n, rows of image, cols of image, rows, cols) and gives one number for each."""
    p = padded(a, rows // 2, cols // 2, rows - 1 - rows // 2, cols - 1 - cols // 2, mode, value)
    return fn(np.lib.stride_tricks.sliding_window_view(p, (rows, cols), axis=(1, 2)))


def bilateral(a: np.ndarray, d: int, sigma_color: float, sigma_space: float) -> np.ndarray:
    radius = max(d // 2 if d > 0 else round(sigma_space * 1.5), 1)
    num, den = np.zeros(a.shape), np.zeros(a.shape)
    for i, j, s in shifts(a, 2 * radius + 1, 2 * radius + 1):
        r2 = (i - radius) ** 2 + (j - radius) ** 2
        if r2 <= radius * radius:
            w = np.exp(-r2 / (2 * sigma_space**2) - (s - a) ** 2 / (2 * sigma_color**2))
            num += w * s
            den += w
    return num / den


def median(a: np.ndarray, size: int) -> np.ndarray:
    return np.sort(np.stack([s for _, _, s in shifts(a, size, size)]), axis=0)[size * size // 2]


def guided(guide: np.ndarray, src: np.ndarray, size: int, eps: float = 1500.0) -> np.ndarray:
    mi, mp = box(guide, size, size), box(src, size, size)
    cov = box(guide * src, size, size) - mi * mp
    var = box(guide * guide, size, size) - mi * mi
    a = cov / (var + eps)
    return box(a, size, size) * guide + box(mp - a * mi, size, size)


_PYR = np.array([1, 4, 6, 4, 1]) / 16


def pyramid_down(a: np.ndarray) -> np.ndarray:
    return separable(a, _PYR, _PYR)[:, ::2, ::2]


def pyramid_up(a: np.ndarray) -> np.ndarray:
    """Twice the size: zeros between the samples, [1 4 6 4 1] / 8 both ways. Outside, an index below
    zero is taken positive and one beyond the end is the last."""

    def along(x: np.ndarray) -> np.ndarray:
        n = x.shape[-1]
        before = x[..., np.abs(np.arange(n) - 1)]
        after = x[..., np.minimum(np.arange(n) + 1, n - 1)]
        out = np.empty((*x.shape[:-1], 2 * n))
        out[..., ::2] = (before + 6 * x + after) / 8
        out[..., 1::2] = (x + after) / 2
        return out

    return along(along(a.astype(float)).swapaxes(1, 2)).swapaxes(1, 2)


#: Row and column of each neighbour in a code's order of bits.
CLOCKWISE = {
    1: ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)),
    3: ((-3, 0), (-2, -2), (0, -3), (2, -2), (3, 0), (2, 2), (0, 3), (-2, 2)),
}
#: The order in which the rotation-invariant code walks, from the one above.
AGAINST = {
    1: ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1)),
    3: ((-3, 0), (-2, -2), (0, -3), (2, -2), (3, 0), (2, 2), (0, 3), (-2, 2)),
}


def _around(a: np.ndarray, places, radius: int) -> np.ndarray:
    p = padded(a, radius, radius, radius, radius)
    return np.stack([p[:, radius + y : radius + y + a.shape[1], radius + x : radius + x + a.shape[2]] for y, x in places])


def lbp(a: np.ndarray, radius: int) -> np.ndarray:
    near = _around(a, CLOCKWISE[radius], radius)
    return ((a <= near) * (1 << np.arange(8))[:, None, None, None]).sum(0).astype(float)


def rotated_lbp(a: np.ndarray, radius: int) -> np.ndarray:
    near = _around(a, AGAINST[radius], radius)
    diff = np.abs(a - near)
    start = np.where(diff.max(0) > 0, (8 - diff.argmax(0)) % 8, 0)
    bits = 1 << ((np.arange(8)[:, None, None, None] + start) % 8)
    return ((a <= near) * bits).sum(0).astype(float)


def ltp(a: np.ndarray, radius: int, thresh: float) -> tuple[np.ndarray, np.ndarray]:
    near = _around(a, CLOCKWISE[radius], radius)
    bits = (1 << np.arange(8))[:, None, None, None]
    return ((a + thresh <= near) * bits).sum(0).astype(float), ((a >= near + thresh) * bits).sum(0).astype(float)


def fft_convolve(a: np.ndarray, kernel) -> np.ndarray:
    """True convolution (kernel turned by half a circle) with mirrored borders, by FFT."""
    k = np.asarray(kernel, float)
    h, w = k.shape
    p = padded(a, h - 1 - h // 2, w - 1 - w // 2, h // 2, w // 2)
    size = (p.shape[1] + h - 1, p.shape[2] + w - 1)
    full = np.fft.irfft2(np.fft.rfft2(p, size) * np.fft.rfft2(k, size), size)
    return full[:, h - 1 : h - 1 + a.shape[1], w - 1 : w - 1 + a.shape[2]]


def multiply_spectra(a: np.ndarray, b: np.ndarray, scale: float = 1.0, correlation: bool = False) -> np.ndarray:
    return a * (np.conj(b) if correlation else b) * scale
