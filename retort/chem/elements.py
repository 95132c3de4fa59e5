"""Elements: symbols, standard atomic weights, outer electrons, usual valences."""

from __future__ import annotations

# Symbols by atomic number, and abridged standard atomic weights (mass number where there is none).
SYMBOLS = (
    "* H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo "
    "Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb "
    "Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
WEIGHTS = tuple(map(float, (
    "0 1.008 4.0026 6.94 9.0122 10.81 12.011 14.007 15.999 18.998 20.180 22.990 24.305 26.982 28.085 30.974 32.06 35.45 "
    "39.95 39.098 40.078 44.956 47.867 50.942 51.996 54.938 55.845 58.933 58.693 63.546 65.38 69.723 72.630 74.922 78.971 "
    "79.904 83.798 85.468 87.62 88.906 91.224 92.906 95.95 97 101.07 102.91 106.42 107.87 112.41 114.82 118.71 121.76 127.60 "
    "126.90 131.29 132.91 137.33 138.91 140.12 140.91 144.24 145 150.36 151.96 157.25 158.93 162.50 164.93 167.26 168.93 "
    "173.05 174.97 178.49 180.95 183.84 186.21 190.23 192.22 195.08 196.97 200.59 204.38 207.2 208.98 209 210 222 223 226 227 "
    "232.04 231.04 238.03 237 244 243 247 247 251 252 257 258 259 262 267 270 269 270 270 278 281 281 285 286 289 289 293 293 294"
).split()))
NUMBER = {s: i for i, s in enumerate(SYMBOLS)}

#: Usual valences of neutral atoms; an ion has those of the neutral atom with as many electrons.
VALENCES = {
    1: (1,), 5: (3,), 6: (4,), 7: (3,), 8: (2,), 9: (1,), 14: (4,), 15: (3, 5, 7), 16: (2, 4, 6), 17: (1, 3, 5, 7),
    32: (4,), 33: (3, 5, 7), 34: (2, 4, 6), 35: (1, 3, 5, 7), 52: (2, 4, 6), 53: (1, 3, 5, 7), 85: (1, 3, 5, 7),
}
#: Of the elements with usual valences, and of alkali and alkaline earth metals.
OUTER = {n: e for n, e in (
    *((n, 1) for n in (1, 3, 11, 19, 37, 55, 87)), *((n, 2) for n in (4, 12, 20, 38, 56, 88)), *((n, 3) for n in (5, 13, 31)),
    *((n, 4) for n in (6, 14, 32)), *((n, 5) for n in (7, 15, 33)), *((n, 6) for n in (8, 16, 34, 52)), *((n, 7) for n in (9, 17, 35, 53, 85)),
)}
_NOBLE = (0, 2, 10, 18, 36, 54, 86)


def valences(number: int, charge: int) -> tuple[int, ...] | None:
    """None: anything goes."""
    if number not in VALENCES:
        return None
    if not charge:
        return VALENCES[number]
    like = number - charge
    if like in VALENCES and like != 1:
        return VALENCES[like]
    return (0,) if like in _NOBLE or number == 1 else None


def outer_electrons(number: int) -> int:
    return OUTER.get(number, number - max(n for n in _NOBLE if n < number) if number else 0)
