"""Trades, units and stages of work lines, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import earliest

# Work categories and the words that tell them; the earliest match in a description wins.
CATEGORIES = {
    "Earthworks/Excavation": r"excavat|earthwork|backfill|\bfill\b|grading|clearing|disposal|dewater|trench",
    "Demolition": r"demolit|dismantl|\bbreak|removal|salvage|strip",
    "Piling/Foundations": r"pil(e|ing)|bored|caisson|footing|foundation",
    "Concrete": r"concrete(?!\s*block)|\brcc\b|blinding|screed|\bslab|grade \d|c\d{2}\b|pour",
    "Reinforcement": r"reinforc(?!ed\s+concrete)|rebar|steel bar|\bmesh|bending",
    "Formwork": r"formwork|shutter|falsework",
    "Structural Steel": r"structural steel|steelwork|\bfabricat|purlin|truss|bracing",
    "Masonry/Blockwork": r"block|brick|masonry|thermal ?stone",
    "Pipework/Drainage": r"\bpipe|sewer|foul|drainage|manhole|culvert|gully|gravity|rising main|\bgrp\b|vitrified",
    "Roads/Paving": r"asphalt|paving|\broad|kerb|pavement|interlock|sub-?base|road base",
    "Windows/Doors/Facade": r"window|\bdoor|aluminum|aluminium|glazing|glass|curtain wall|facade|cladding|shopfront",
    "Finishes": r"plaster|render|paint|\btile|floor(ing)?|ceiling|gypsum|skirting|coving|wallpaper|screed",
    "Waterproofing/Insulation": r"waterproof|membrane|insulat|damp proof|tanking",
    "Electrical (MEP)": r"cable|switchgear|transformer|busduct|electric|lighting|\bpanel|\bmv\b|\bhv\b|\blv\b|earthing|containment",
    "Mechanical/HVAC (MEP)": r"chiller|\bpump|hvac|cooling|\bcrah|\bcdu\b|ducting|\bahu\b|ventilat|refrigerant|mechanical",
    "Fire Protection": r"fire (extinguish|blanket|protec|detec|alarm|fighting)|sprinkler|\bfe-\d",
    "Sanitary/Accessories": r"toilet|sanitary|\bwc\b|mirror|towel|holder|\bbin\b|basin|accessor|\btray\b",
    "Landscape/Softscape": r"\bplant|\btree|palm|softscape|landscape|irrigat|shrub|turf|topsoil",
    "Preliminaries/General": r"prelim|mobiliz|insurance|provisional|general item|attendance|supervision|overhead",
}
OTHER = "Other/Uncategorized"
# The order in which trades follow each other on site.
SEQUENCE = (
    "Preliminaries/General", "Demolition", "Earthworks/Excavation", "Piling/Foundations", "Formwork", "Reinforcement", "Concrete", "Structural Steel", "Masonry/Blockwork",
    "Waterproofing/Insulation", "Windows/Doors/Facade", "Mechanical/HVAC (MEP)", "Electrical (MEP)", "Fire Protection", "Pipework/Drainage", "Sanitary/Accessories", "Finishes",
    "Roads/Paving", "Landscape/Softscape", "Other/Uncategorized",
)
# Trades that are below ground always, or where a word says so.
BELOW_GROUND = ("Piling/Foundations", "Earthworks/Excavation", "Demolition")
STAGED = ("Concrete", "Reinforcement", "Formwork", "Waterproofing/Insulation", "Masonry/Blockwork")
SUBSTRUCTURE = r"(?i)\b(foundations?|footings?|pile[\s-]?caps?|piling|rafts?|blinding|substructure|ground\s+beams?|pad\s+bases?|tie\s+beams?|lean\s+concrete|underground|below\s+ground)\b"
ENABLING = r"(?i)(blinding|lean\s+concrete|sub[\s-]?base|levelling\s+course)"
AFTER_POUR = r"(?i)(retaining\s+wall|to\s+walls?\b|wall\s+face|vertical|tanking\s+to\s+(?:walls?|sides?)|sides?\s+of|external\s+face|protection\s+board)"
# The unit that a kind of work is measured in; the first rule with a match wins.
UNIT_RULES = (
    ("m2", r"formwork|form work|shutter|falsework"),
    ("m2", r"fabric reinforc|mesh reinforc|reinforc\w* mesh|welded fabric|\bbrc\b"),
    ("m3", r"\bbedding|\bsurround|haunch|granular fill|pipe protection"),
    ("nr", r"manhole|inspection chamber|\bchamber\b|catch ?pit|\bgully|headwall|\bvalve|hydrant|\bfitting|\bbend\b|\bjunction|\btee\b|coupling|penstock|sluice|washout|air ?valve"),
    ("m", r"\bpipe|pipe ?work|gravity sewer|\bsewer|\bfoul|waste ?water|rising main|\bculvert|\bduct\b|ducting|\bcable|\bconduit|trunking|containment|\bkerb|\bedging|\bchannel|\bcoping|"
          r"skirting|handrail|balustrade|\bdpc\b|damp proof course|string course|expansion joint"),
    ("m2", r"\bplaster|render|\bskim|\bpaint|decorat|\btiling|\btile\b|floor(ing| finish| screed)|\bscreed|\bceiling|gypsum|partition|blockwork|brickwork|masonry|cladding|waterproof|tanking|"
           r"\bmembrane|insulat|surfacing|asphalt|bituminous|wearing course|interlock|\bpaving|geotextile|site clearance|topsoil"),
    ("t", r"\brebar\b|\breinforcement\b|reinforcing (bar|steel)|high[- ]yield|structural steel|steel ?work|\brsj\b|purlin|mild steel bar"),
    ("m3", r"excavat|earth ?work|back ?fill|\bfilling\b|imported fill|selected fill|\bfill material|disposal|cart away|muck away|remove surplus|\bconcrete|\brcc\b|blinding|grade [cm]|"
           r"\bc\d{2}\b|sub-?base|road ?base|hardcore|granular"),
    ("nr", r"\bdoor|\bwindow|ironmonger|sanitary|\bwc\b|\bbasin|\bsink|\bmirror|accessor|\bfixture|\bsocket|\bswitch|\bpanel\b|transformer|\bpump\b|chiller|\bahu\b|\bcrah|manhole cover|"
           r"\blift\b|escalator|\btree\b|\bshrub|waste bin|extinguisher"),
    ("sum", r"preliminar|mobili[sz]|insurance|provisional sum|commission|\bday ?work|contingency|allow for|general item"),
)
# Spellings of units as bills of measured work have them.
MEASURED = {
    "lm": "m", "l.m": "m", "rm": "m", "r.m": "m", "m.": "m", "mq": "m2", "sqm": "m2", "sq.m": "m2", "cum": "m3", "cu.m": "m3", "mc": "m3", "nos": "nr", "no": "nr",
    "no.": "nr", "ea": "nr", "each": "nr", "pcs": "nr", "tonne": "t", "ton": "t", "ls": "sum", "item": "sum", "lot": "sum",
}
# What kind of quantity a unit measures.
UNIT_CLASSES = {
    "m": "linear", "m2": "area", "m3": "volume", "kg": "mass", "t": "mass", "mt": "mass", "ton": "mass", "tonne": "mass", "no": "count", "set": "count", "pair": "count", "bay": "count", "ls": "lump",
}
# Goods by the first row with one of its words; category, lead time in weeks and who supplies them.
GOODS = (
    ("structural steel|steel frame|steel beam|steel column", "Structural Steel", 16, "Steel Fabricator"),
    ("curtain wall|facade|curtain_wall", "Glazing / Facades", 22, "Specialist Glazier"),
    ("glass|glazing", "Glazing", 18, "Glazing Supplier"),
    ("lift|elevator|escalator", "Vertical Transport", 28, "OEM / Specialist"),
    ("hvac|ductwork|air handling|chiller|cooling", "Mechanical / HVAC", 16, "MEP Contractor"),
    ("switchgear|transformer|generator|hv cable", "HV Electrical", 20, "Electrical Contractor"),
    ("electrical|panel|cable|lighting|power", "Electrical", 10, "Electrical Contractor"),
    ("pump|chilled water|fire suppression", "Mechanical Plant", 14, "MEP Contractor"),
    ("plumbing|pipe|sanitary|drain", "Plumbing", 8, "Plumbing Contractor"),
    ("stone|marble|granite|cladding", "Stone / Cladding", 20, "Stone Supplier"),
    ("rebar|reinforcement", "Rebar / Steel", 6, "Steel Stockholder"),
    ("concrete|cement", "Concrete", 2, "Ready-Mix Supplier"),
    ("steel|structural", "Structural Steel", 14, "Steel Fabricator"),
    ("pile|piling|foundation", "Groundworks", 8, "Specialist Piling"),
    ("door|window|joinery|frame", "Joinery / Openings", 10, "Joinery Supplier"),
    ("tile|floor|finish|paint|plaster|ceiling", "Finishes", 6, "Finishing Contractor"),
    ("formwork|shuttering|scaffold", "Temporary Works", 3, "Plant Hire"),
    ("waterproof|membrane|roof", "Waterproofing / Roofing", 8, "Specialist Subcontractor"),
    ("insulation", "Insulation", 6, "Insulation Supplier"),
)
REST_OF_GOODS = ("General Materials", 4, "General Supplier")


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def bare_unit(text: Column) -> Column:
    return F.replace(F.translate(F.lower(F.trim(F.coalesce(text, F.lit("")))), "²³", "23"), F.lit(" "), F.lit(""))


def category(description: Column) -> Column:
    return earliest(F.coalesce(description, F.lit("")), CATEGORIES, OTHER)


def stage(description: Column, of: Column) -> Column:
    """Whether a line of this category is below ground."""
    return F.when(of.isin(*BELOW_GROUND) | (of.isin(*STAGED) & description.rlike(SUBSTRUCTURE)), "substructure").otherwise("superstructure")


def site_rank(description: Column, of: Column) -> Column:
    """The place of a line among the trades: enabling layers come before what stands on them, wall tanking after the pour."""
    place = lookup({c: float(i) for i, c in enumerate(SEQUENCE)}, of)
    piling, concrete = SEQUENCE.index("Piling/Foundations"), SEQUENCE.index("Concrete")
    sealing = (stage(description, of) == "substructure") & (of == "Waterproofing/Insulation")
    return (
        F.when(description.rlike(ENABLING), piling + 0.5)
        .when(sealing & description.rlike(AFTER_POUR), concrete + 0.5)
        .when(sealing, piling + 0.7)
        .otherwise(F.coalesce(place, F.lit(float(len(SEQUENCE)))))
    )


def expected_unit(description: Column) -> Column:
    """The unit that the work is usually measured in; null where no rule says."""
    text = F.trim(F.coalesce(description, F.lit("")))
    return F.coalesce(*(F.when(text.rlike(f"(?i){p}"), u) for u, p in UNIT_RULES))


def measured_unit(text: Column) -> Column:
    bare = bare_unit(text)
    return F.coalesce(lookup(MEASURED, bare), bare)


def reconciled_unit(stated: Column, description: Column) -> Column:
    """(unit, source, suspect, expected): a blank unit is filled from the work; a stated one stays and is suspect where the work says another."""
    expected, said = expected_unit(description), F.trim(F.coalesce(stated, F.lit("")))
    blank = (said == "") | (F.lower(said) == "nan")
    differs = expected.isNotNull() & (measured_unit(said) != measured_unit(expected))
    return F.struct(
        F.when(blank, F.coalesce(expected, F.lit(""))).otherwise(said).alias("unit"),
        F.when(blank & expected.isNotNull(), "inferred").otherwise("parsed").alias("source"),
        (~blank & differs).alias("suspect"),
        F.when(~blank & differs, expected).alias("expected"),
    )


def unit_class(unit: Column) -> Column:
    return lookup(UNIT_CLASSES, unit)


def goods(name: Column) -> Column:
    """(category, lead_weeks, supplier) of what is to be bought."""
    low = F.lower(name)
    row = lambda c, weeks, who: F.struct(F.lit(c).alias("category"), F.lit(weeks).alias("lead_weeks"), F.lit(who).alias("supplier"))
    return F.coalesce(*(F.when(low.rlike(words), row(*rest)) for words, *rest in GOODS), row(*REST_OF_GOODS))


# Indicative base rates in USD by item, first match first, with unit and what they include.
BASE_RATES = {
    "concrete": ("m3", 150.0, "material"), "ready-mix concrete": ("m3", 150.0, "material"), "steel": ("kg", 1.0, "material"), "rebar": ("kg", 1.0, "material"),
    "reinforcing steel": ("kg", 1.0, "material"), "structural steel": ("kg", 2.5, "material"), "formwork": ("m2", 35.0, "all_in"), "blockwork": ("m2", 45.0, "all_in"),
    "plaster": ("m2", 18.0, "all_in"), "paint": ("m2", 12.0, "all_in"), "tiles": ("m2", 60.0, "all_in"), "backfill": ("m3", 20.0, "all_in"),
    "asphalt": ("m2", 40.0, "all_in"), "excavation": ("m3", 15.0, "plant_labour"), "earthworks": ("m3", 15.0, "plant_labour"),
}
# What places cost against the base, and what kinds of projects do.
LOCATION_FACTORS = {
    "us national average": 1.0, "united states": 1.0, "usa": 1.0, "us": 1.0, "us nyc": 1.35, "new york": 1.35, "us sf": 1.40, "san francisco": 1.40, "canada": 1.15, "toronto": 1.20, "vancouver": 1.22,
    "saudi arabia": 0.85, "saudi": 0.85, "ksa": 0.85, "riyadh": 0.85, "jeddah": 0.88, "dammam": 0.84, "neom": 0.95, "uae": 0.95, "united arab emirates": 0.95, "dubai": 0.95, "abudhabi": 0.95, "abu dhabi": 0.95,
    "sharjah": 0.92, "qatar": 0.98, "doha": 0.98, "kuwait": 0.92, "bahrain": 0.90, "oman": 0.82, "muscat": 0.82, "jordan": 0.70, "amman": 0.70, "lebanon": 0.72, "iraq": 0.80, "baghdad": 0.80,
    "egypt": 0.55, "cairo": 0.55, "morocco": 0.60, "casablanca": 0.60, "algeria": 0.58, "tunisia": 0.55, "libya": 0.62,
    "south africa": 0.65, "johannesburg": 0.65, "cape town": 0.66, "nigeria": 0.70, "lagos": 0.70, "kenya": 0.60, "nairobi": 0.60, "ghana": 0.65, "ethiopia": 0.55, "tanzania": 0.58,
    "uk": 1.25, "united kingdom": 1.25, "london": 1.35, "ireland": 1.20, "dublin": 1.22, "germany": 1.30, "france": 1.25, "paris": 1.32, "netherlands": 1.30, "spain": 1.00, "madrid": 1.02, "italy": 1.05,
    "poland": 0.80, "switzerland": 1.70, "zurich": 1.75, "sweden": 1.35, "norway": 1.55, "portugal": 0.95, "turkey": 0.65, "istanbul": 0.65,
    "australia": 1.30, "sydney": 1.35, "melbourne": 1.30, "new zealand": 1.20, "singapore": 1.20, "japan": 1.25, "tokyo": 1.35, "south korea": 1.00, "seoul": 1.02, "hong kong": 1.45,
    "china": 0.60, "shanghai": 0.70, "beijing": 0.68, "malaysia": 0.55, "kuala lumpur": 0.55, "indonesia": 0.50, "jakarta": 0.50, "philippines": 0.50, "manila": 0.50, "thailand": 0.55, "bangkok": 0.55,
    "vietnam": 0.45, "india": 0.35, "mumbai": 0.35, "delhi": 0.35, "pakistan": 0.35, "bangladesh": 0.35, "sri lanka": 0.40,
    "brazil": 0.65, "sao paulo": 0.68, "mexico": 0.60, "mexico city": 0.62, "argentina": 0.55, "chile": 0.75, "colombia": 0.58, "peru": 0.55,
}
PROJECT_FACTORS = {
    "general_building": 1.0, "building": 1.0, "data_center": 1.15, "solar_plant": 0.95, "wind_farm": 1.05, "infrastructure": 0.95, "industrial": 1.10, "residential": 0.95, "commercial": 1.0, "healthcare": 1.20,
}


def spoken(text: Column) -> Column:
    """Lower case, with blanks for slashes, hyphens and underscores."""
    return F.trim(F.replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "/-_", "   "), F.lit("  "), F.lit(" ")))


def benchmark_rate(item: Column, location: Column, project: Column) -> Column:
    """(item, unit, basis, base, adjusted, location_known): the indicative rate of an item, null where none is known.

    An item is the base item of its very name, else the first that is part of its name or has it as a part; a blank
    one is none. Places and kinds of projects that aren't known count 1. Names are compared as ``spoken``, so kinds
    written with an underscore are met by their factor only if the table has them as one word.
    """
    name = spoken(item)
    keys = F.array(*map(F.lit, BASE_RATES))
    found = F.filter(keys, lambda k: (name != "") & (F.contains(name, k) | F.contains(k, name)))
    key = F.when(F.array_contains(keys, name), name).otherwise(F.get(found, F.lit(0)))
    entry = F.element_at(F.create_map(*(x for k, (u, r, b) in BASE_RATES.items() for x in (F.lit(k), F.struct(F.lit(u).alias("unit"), F.lit(r).alias("rate"), F.lit(b).alias("basis"))))), key)
    place, kind = lookup(LOCATION_FACTORS, spoken(location)), lookup(PROJECT_FACTORS, spoken(project))
    adjusted = F.round(entry.rate * F.coalesce(place, F.lit(1.0)) * F.coalesce(kind, F.lit(1.0)), 2)
    return F.struct(key.alias("item"), entry.unit.alias("unit"), entry.basis.alias("basis"), entry.rate.alias("base"), adjusted.alias("adjusted"), place.isNotNull().alias("location_known"))
