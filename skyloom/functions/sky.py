"""Sky geometry: HEALPix ring pixels (Gorski et al. 2005) and angular separation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def check_nside(nside: int) -> None:
    if nside <= 0 or nside & (nside - 1):
        raise ValueError(f"nside must be a positive power of two, not {nside}")


def ang2pix_ring(lon: Column, lat: Column, nside: int) -> Column:
    """The ring pixel of a position in degrees; null if a coordinate isn't finite or |lat| > 90."""
    check_nside(nside)
    n = float(nside)
    # By colatitude, as usual for these pixels: on the equator this decides between two rings.
    z = F.cos(F.lit(math.pi / 2) - F.radians(lat))
    za = F.abs(z)
    tt = F.pmod(F.radians(lon), F.lit(2 * math.pi)) / (math.pi / 2)
    tt = F.when(tt >= 4.0, 0.0).otherwise(tt)
    # equatorial belt
    jp, jm = F.floor(n * (0.5 + tt) - n * z * 0.75), F.floor(n * (0.5 + tt) + n * z * 0.75)
    ring = nside + 1 + jp - jm
    k = 1 - F.pmod(ring, F.lit(2))
    ip = F.pmod(F.floor((jp + jm - nside + k + 1) / 2), F.lit(4 * nside))
    belt = 2 * nside * (nside - 1) + (ring - 1) * 4 * nside + ip
    # caps
    t = n * F.sqrt(3.0 * (1.0 - za))
    tp = tt - F.floor(tt)
    cp, cm = F.floor(tp * t), F.floor((1.0 - tp) * t)
    cring = cp + cm + 1
    cip = F.pmod(F.floor(tt * cring), 4 * cring)
    north = 2 * cring * (cring - 1) + cip
    south = 12 * nside * nside - 2 * cring * (cring + 1) + cip
    pix = F.when(za <= 2.0 / 3.0, belt).when(z > 0, north).otherwise(south)
    good = ~F.isnan(lon) & ~F.isnan(lat) & (F.abs(lon) < F.lit(float("inf"))) & (F.abs(lat) <= 90.0)
    return F.when(good, pix.cast("long"))


def pix2ang_ring(pix: np.ndarray, nside: int) -> tuple[np.ndarray, np.ndarray]:
    """Centers (lon, lat) in degrees of ring pixels; for maps, on the driver."""
    check_nside(nside)
    pix = np.asarray(pix, np.int64)
    total, cap = 12 * nside * nside, 2 * nside * (nside - 1)
    z, phi = np.empty(len(pix)), np.empty(len(pix))
    mirror = np.where(pix >= total - cap, total - 1 - pix, pix)
    polar = (pix < cap) | (pix >= total - cap)
    p = mirror[polar]
    i = ((1 + np.floor(np.sqrt(1 + 2.0 * p + 1e-9))) // 2).astype(np.int64)
    i = np.where(2 * i * (i - 1) > p, i - 1, i)
    i = np.where(2 * i * (i + 1) <= p, i + 1, i)
    j = p - 2 * i * (i - 1)
    south = pix[polar] >= total - cap
    z[polar] = np.where(south, -1, 1) * (1 - i * i / (3.0 * nside * nside))
    j = np.where(south, 4 * i - 1 - j, j)
    phi[polar] = (j + 0.5) * math.pi / (2 * i)
    e = pix[~polar] - cap
    i, j = e // (4 * nside) + nside, e % (4 * nside)
    s = (i + nside) % 2  # rings with an odd distance to the cap's last are shifted by half a pixel
    z[~polar] = (2 * nside - i) * 2.0 / (3 * nside)
    phi[~polar] = (j + np.where(s == 0, 0.5, 0.0)) * math.pi / (2 * nside)
    return np.degrees(phi), np.degrees(np.arcsin(z))


def pixel_centers(pix: Column, nside: int) -> tuple[Column, Column]:
    """As :func:`pix2ang_ring`, as columns; null outside the sphere's pixels."""
    check_nside(nside)
    total, cap, n = 12 * nside * nside, 2 * nside * (nside - 1), float(nside)
    south = pix >= total - cap
    p = F.when(south, F.lit(total - 1) - pix).otherwise(pix)
    # The ring of a cap: the greatest i with 2 i (i - 1) <= p, one step either way for the root's rounding.
    i = F.floor((1 + F.floor(F.sqrt(1 + 2.0 * p + 1e-9))) / 2)
    i = F.when(2 * i * (i - 1) > p, i - 1).when(2 * i * (i + 1) <= p, i + 1).otherwise(i)
    j = p - 2 * i * (i - 1)
    j = F.when(south, 4 * i - 1 - j).otherwise(j)
    cap_z = (1 - i * i / (3.0 * n * n)) * F.when(south, -1.0).otherwise(1.0)
    cap_phi = (j + 0.5) * math.pi / (2 * i)
    e = pix - cap
    ring, place = F.floor(e / (4 * nside)) + nside, F.pmod(e, F.lit(4 * nside))
    belt_z = (2 * nside - ring) * 2.0 / (3 * nside)
    belt_phi = (place + F.when(F.pmod(ring + nside, F.lit(2)) == 0, 0.5).otherwise(0.0)) * math.pi / (2 * nside)
    polar = (pix < cap) | south
    z, phi = F.when(polar, cap_z).otherwise(belt_z), F.when(polar, cap_phi).otherwise(belt_phi)
    good = (pix >= 0) & (pix < total)
    return F.when(good, F.degrees(phi)), F.when(good, F.degrees(F.asin(z)))


def separation(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Angular separation in degrees by the haversine formula."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return F.degrees(2 * F.asin(F.sqrt(F.least(a, F.lit(1.0)))))
