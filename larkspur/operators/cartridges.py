"""Cartridges and makers as reference tables: each with the spellings that listings have, made from a short listing by rules.

Spellings are compared in the form of :func:`normal`: lower case, one kind of times sign without spaces around it, units
next to their numbers, no stops after abbreviations.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import collapse_space

#: Cartridges by name; after the colon what else they are called.
CARTRIDGES = """
.17 HMR: 17 hmr
.17 Mach 2: 17 hm2
.204 Ruger
.22 LR: .22 long rifle, .22lr, 22lr
.22 Short
.22 Magnum: .22 wmr, .22 win mag, .22 mag
.22 Hornet
.22-250 Remington: .22-250
.218 Bee
.220 Swift
.221 Fireball
.222 Remington
.223 Remington: .223
.224 Valkyrie
.240 Weatherby Magnum
.243 Winchester: .243
.244 Remington
.25 ACP: .25 auto, 6.35mm browning, 6.35mm
.25-06 Remington: .25-06
.25-20 Winchester: .25-20
.25-35 Winchester: .25-35
.250 Savage: .250-3000
.257 Roberts
.257 Weatherby Magnum
.260 Remington
.264 Winchester Magnum
.270 Winchester: .270
.270 WSM
.280 Remington
.284 Winchester
.30 Carbine: .30 m1 carbine, 7.62x33mm
.30 Luger: 7.65mm luger, 7.65mm parabellum, 7.65x21mm
.30 Super Carry
.30-06: .30-06 springfield, 30-06, 7.62x63mm
.30-30 Winchester: .30-30, 30-30, .30 wcf
.30-40 Krag: .30-40, .30 army
.300 AAC Blackout: .300 blackout, .300 blk
.300 PRC
.300 Savage
.300 Weatherby Magnum
.300 Winchester Magnum: .300 win mag
.300 WSM
.303 British: .303
.303 Savage
.308 Winchester: .308, 7.62x51mm, 7.62 nato
.32 ACP: .32 auto, 7.65mm browning, 7.65x17mm
.32 H&R Magnum
.32 S&W Long
.32 S&W
.32 Winchester Special: .32 special
.32-20 Winchester: .32-20
.327 Federal Magnum
.338 Federal
.338 Lapua Magnum: .338 lapua
.338 Winchester Magnum
.348 Winchester
.35 Remington
.35 Whelen
.350 Legend
.356 Winchester
.357 Magnum: .357
.357 SIG
.358 Winchester
.36 Caliber
.375 H&H Magnum
.375 Winchester
.38 S&W
.38 Special: .38 spl, .38 spc
.38 Super
.38-40 Winchester: .38-40
.38-55 Winchester: .38-55
.380 ACP: .380, .380 auto, 9mm kurz, 9x17mm, 9mm browning short
.40 S&W: .40
.401 Winchester
.404 Jeffery
.405 Winchester
.41 Magnum
.416 Rigby
.44 Magnum
.44 Special
.44-40 Winchester: .44-40
.444 Marlin
.45 ACP: .45 auto, 11.43x23mm
.45 Colt: .45 long colt, .45 lc
.45 GAP
.45-70 Government: .45-70
.450 Bushmaster
.454 Casull
.455 Webley
.458 SOCOM
.458 Winchester Magnum
.460 S&W Magnum
.480 Ruger
.50 AE: .50 action express
.50 Beowulf
.50 BMG
.50-70 Government: .50-70
.500 S&W Magnum
.577 Snider
.577-450 Martini-Henry: .577-450, .577/450
5.45x39mm: 5.45
5.56x45mm: 5.56 nato, 5.56
5.7x28mm: 5.7
6mm ARC
6mm Remington
6.5 Creedmoor: 6.5mm creedmoor
6.5 Grendel: 6.5mm grendel
6.5x50mm Arisaka: 6.5mm arisaka, 6.5mm japanese, 6.5x50mmsr
6.5x52mm Carcano: 6.5mm carcano
6.5x54mm Mannlicher: 6.5mm mannlicher
6.5x55mm: 6.5x55mm swedish, 6.5 swede, 6.5mm swedish
6.8 SPC
7mm Mauser: 7x57mm, 7mm mauser
7mm Remington Magnum
7mm-08 Remington: 7mm-08
7.35x51mm Carcano: 7.35mm carcano
7.5x54mm French: 7.5mm french, 7.5x54mm mas
7.5x55mm Swiss: 7.5mm swiss, 7.5x55mm, gp11
7.62x25mm Tokarev: 7.62x25mm, 7.62mm tokarev
7.62x38mmR Nagant: 7.62mm nagant, 7.62x38mmr
7.62x39mm: 7.62x39
7.62x54mmR: 7.62x54r, 7.62x54mm r, 7.62x54
7.63mm Mauser: 7.63x25mm, .30 mauser
7.65x53mm Argentine: 7.65mm argentine, 7.65x53mm
7.7x58mm Arisaka: 7.7mm arisaka, 7.7mm japanese, 7.7mm jap
8mm Lebel: 8x50mmr lebel, 8x50r lebel
8mm Mauser: 7.92x57mm, 8x57mm, 7.92mm mauser, 8x57mmjs
8mm Nambu: 8x22mm
8x56mmR: 8x56r
9mm Luger: 9mm, 9x19mm, 9mm para, 9mm parabellum, 9mm nato
9mm Makarov: 9x18mm, 9mm mak
9mm Largo: 9x23mm largo
10mm Auto: 10mm
11mm Mauser: 11x60mmr
11mm Gras
12 Gauge: 12 ga
16 Gauge: 16 ga
20 Gauge: 20 ga
28 Gauge: 28 ga
.410 Bore: .410 gauge, .410
"""
#: Makers, and what else they are called.
MAKERS = """
Anschutz: anschütz
Astra
Benelli
Beretta: pietro beretta
Bersa
Browning: fn browning
Carl Gustaf: carl gustafs
Chiappa
Colt: colts, colt's
CZ: ceska zbrojovka, česká zbrojovka, brno
DWM: deutsche waffen
Enfield: rsaf enfield
FN: fabrique nationale, fn herstal
Glock
Heckler & Koch: h&k, hk, heckler and koch
Henry
Husqvarna
Ithaca
Izhevsk: izhmash
Kimber
Luger
Makarov: baikal
Marlin
Mauser: mauser werke, mauser oberndorf
Mosin: mosin nagant, mosin-nagant
Mossberg
Norinco
Remington: remington arms
Rock Island: rock island arsenal
Ruger: sturm ruger, sturm, ruger
Sako
Savage: savage arms
SIG: sig sauer, sigsauer, sig-sauer
Smith & Wesson: s&w, smith and wesson
Springfield: springfield armory, springfield arsenal
Star
Steyr: steyr mannlicher
Taurus
Tula
Uberti
Walther
Webley: webley & scott
Winchester: winchester repeating arms
Zastava
"""
#: What listings write for a word of a name.
SHORT = {"winchester": ["win"], "remington": ["rem"], "magnum": ["mag"], "special": ["spl", "spec"], "government": ["govt", "gov't"], "weatherby": ["wby"], "springfield": ["spfld"], "auto": ["automatic"]}


def normal(text: Column) -> Column:
    """A listing's words in the form of the spellings."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "×", "x")
    out = F.regexp_replace(out, r"(?<=\d) ?x ?(?=\d)", "x")
    out = F.regexp_replace(out, r"(?<=\d)[ -]mm(?![a-z])", "mm")
    return collapse_space(F.regexp_replace(out, r"(?<=[a-z])\.(?=[ ,;]|$)", " "))


def spellings(name: str) -> set[str]:
    """What a name is written like: with or without ``mm`` after a case's length, its words shortened, a caliber without its point."""
    out = {" ".join(name.lower().split())}
    for word, forms in SHORT.items():
        out |= {re.sub(rf"(?<![a-z]){word}(?![a-z])", f, s) for s in out for f in forms}
    out |= {re.sub(r"(?<=\dx)(\d+)mm", r"\1", s) for s in out}
    # a point can go where something follows that makes it a caliber still
    out |= {s[1:] for s in out if re.match(r"\.\d{2,3}[ -]\S", s)}
    return out


def listed(source: str) -> list[tuple[str, str]]:
    """Spelling and name of each line of a listing. A spelling of two names is the one's that has it as its own name."""
    names: dict[str, str] = {}
    rows = [line.partition(":")[::2] for line in source.strip().splitlines()]
    for own in (True, False):
        for name, others in rows:
            for given in [name] if own else others.split(","):
                for s in spellings(given.strip()) if given.strip() else ():
                    names.setdefault(s, name.strip())
    return sorted(names.items())


def cartridge_table(spark: SparkSession) -> DataFrame:
    """``phrase, value``: the spellings of all cartridges."""
    return spark.createDataFrame(listed(CARTRIDGES), "phrase string, value string")


def maker_table(spark: SparkSession) -> DataFrame:
    """``phrase, value``: the spellings of all makers."""
    return spark.createDataFrame(listed(MAKERS), "phrase string, value string")
