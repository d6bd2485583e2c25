"""Word lists and tables of the matching rules."""

from __future__ import annotations

from dataclasses import dataclass, field

# Results of matching depend on each of them. Where order has no effect (sets of
# words, vehicles' brands, taxonomies, whose labels come sorted) entries stand in order of the alphabet.

STOPWORDS = ("a", "al", "con", "de", "del", "el", "en", "la", "las", "los", "para", "por", "sin", "un", "una", "y")

GENERIC_VEHICLE = ("aa", "ab", "abs", "ano", "at", "ct", "fl", "model", "modelo", "modelos", "mt", "sport", "tp")

GENERIC_PART = (
    "central", "delantera", "delantero", "derecha", "derecho", "exterior", "frontal", "inferior", "inner", "inside",
    "interior", "izquierda", "izquierdo", "lado", "left", "rear", "right", "superior", "trasera", "trasero",
)

#: Label -> tokens; of several labels the first one counts.
SIDES = {"left": ("izquierda", "izquierdo", "left", "lh"), "right": ("derecha", "derecho", "right", "rh")}
POSITIONS = {
    "front": ("delantera", "delantero", "front", "frontal"),
    "rear": ("trasera", "trasero", "rear", "posterior"),
    "inner": ("interior", "inside", "inner"),
    "outer": ("exterior", "outside", "outer"),
    "upper": ("superior", "upper"),
    "lower": ("inferior", "lower"),
}
PRESENTATIONS = {"kit": ("kit", "juego", "set", "combo"), "unit": ("unidad", "unitario", "unit", "individual")}
COLORS = {
    "black": ("negro", "negra", "black"),
    "white": ("blanco", "blanca", "white"),
    "red": ("rojo", "roja", "red"),
    "blue": ("azul", "blue"),
    "gray": ("gris", "grisaceo", "silver", "plata", "gray", "grey"),
    "green": ("verde", "green"),
}
FINISHES = {
    "chrome": ("cromado", "chrome"),
    "matte": ("mate", "matte"),
    "painted": ("pintado", "pintada", "painted", "imprimado", "primer"),
    "textured": ("texturizado", "texturizada", "textured"),
    "gloss": ("brillante", "brilloso", "gloss"),
}
#: Flag, groups, and the note that a mismatch gives.
CONFLICTS = (
    ("side_mismatch", SIDES, "lado distinto al solicitado"),
    ("position_mismatch", POSITIONS, "posicion distinta en el vehiculo"),
    ("presentation_mismatch", PRESENTATIONS, "presentacion distinta entre kit y unidad"),
    ("color_mismatch", COLORS, "color visible distinto al solicitado"),
    ("finish_mismatch", FINISHES, "acabado visible distinto al solicitado"),
)
HARD_FLAGS = ("side_mismatch", "position_mismatch", "presentation_mismatch")
SOFT_CAPS = {"year_mismatch": 45, "color_mismatch": 60, "finish_mismatch": 58}

VEHICLE_BRANDS = (
    "audi", "bmw", "byd", "changan", "chery", "chevrolet", "citroen", "cupra", "dfsk", "dodge", "fiat", "ford", "foton",
    "geely", "great", "greatwall", "gwm", "haval", "hino", "honda", "hyundai", "isuzu", "iveco", "jac", "jeep", "jetour",
    "jinbei", "kia", "lada", "mazda", "mercedes", "mg", "mini", "mitsubishi", "nissan", "peugeot", "porsche", "ram",
    "renault", "seat", "skoda", "subaru", "suzuki", "tesla", "toyota", "volkswagen", "volvo",
)

TAXONOMIES = {
    "accessories_misc": ("accesorio", "accesorios", "antena", "broche", "broches", "emblema", "insonorizante", "kit", "sello", "tapete"),
    "belts_tensioners": ("correa", "correas", "kit distribucion", "polea", "poleas", "reparticion", "tensor", "tensores"),
    "body_panels": ("aleta", "bocel", "bomper", "bumber", "capo", "compuerta", "guardafango", "guia lateral", "parachoque", "panel", "puerta", "spoiler"),
    "brake_fluids": ("brake fluid", "liquido de frenos"),
    "brake_system": ("abs", "balata", "balatas", "bomba de freno", "campana", "disco de freno", "discos de freno", "freno", "frenos", "mordaza", "pastilla", "pastillas", "sensor abs", "zapatas"),
    "cooling": ("bomba de agua", "condensador", "coolant", "electroventilador", "manguera", "mangueras", "radiador", "refrigeracion", "refrigerante", "refrigerantes", "termostato"),
    "driveline": ("cardan", "cruceta", "crucetas", "diferencial", "homocinetica", "semieje", "transmision"),
    "engine_components": ("bomba aceite", "culata", "empaque", "motor", "piston", "pistones", "valvula", "valvulas"),
    "filters": ("filtro", "filtros", "filtracion"),
    "fuel_delivery": ("bomba de combustible", "bomba gasolina", "inyector", "inyectores"),
    "ignition_electrical": ("alternador", "arranque", "bateria", "bobina", "bomba electrica", "bujia", "bujias", "cable electrico", "cables electricos", "electrico", "electrica", "electricas", "sensor", "switch", "terminal electrico"),
    "lighting_headlamps": ("bombillo", "bombillos", "exploradora", "faro", "farola", "farolas", "iluminacion", "luz", "luces", "stop"),
    "lubricants_fluids": ("aceite", "aceites", "aditivo", "aditivos", "grasa", "grasas", "lubricacion", "lubricante", "lubricantes", "quimico", "quimicos"),
    "suspension_steering": ("amortiguador", "amortiguadores", "axial", "barra central", "brazo compensador", "buje", "bujes", "caja de direccion", "cajas de direccion", "direccion", "guaya direccion", "lagrima", "lagrimas", "rodamiento", "rodamientos", "rotula", "rotulas", "semieje", "soporte amortiguador", "soportes de amortiguador", "suspension", "terminal", "terminales", "tijera", "tijeras"),
    "tires_wheels": ("llanta", "llantas", "neumatico", "neumaticos", "rin", "rines", "tire", "tires", "wheel", "wheels"),
    "wipers_visibility": ("limpiaparabrisas", "limpiavidrio", "plumilla", "plumillas", "visibilidad"),
}

KIT_HINTS = ("kit", "jgo", "jgox2", "jgx2", "juego", "par")
WIPERS = ("limpiaparabrisas", "limpiavidrio", "plumilla", "plumillas")
#: What a requested kind of part accepts; kinds in order of priority.
ACCEPTED_SIGNALS = {
    "fuel_filter": ("fuel_filter",),
    "fuel_pump": ("fuel_pump",),
    "wiper_kit": ("wiper_kit",),
    "wiper": ("wiper", "wiper_kit"),
    "spark_plug": ("spark_plug",),
    "filter": ("filter", "fuel_filter"),
}
SPECIFIC_SIGNALS = ("fuel_filter", "fuel_pump", "wiper_kit", "spark_plug")

#: Texts that count as missing when rows are stored.
MISSING = ("no disponible", "none", "null")

# End of the fixed values.


@dataclass(frozen=True)
class ProviderPolicy:
    """Rules that hold for single providers, by id."""

    #: No public references: caps 55 with and 25 without a shared taxonomy, always confirmed by hand.
    category_only: tuple[str, ...] = ()
    #: An internal code only: caps 78 and 60.
    partial: tuple[str, ...] = ()
    notes: dict[str, str] = field(default_factory=dict)


DEFAULT_POLICY = ProviderPolicy()
