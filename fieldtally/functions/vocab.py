"""Controlled values. All are fixed values that must equal the ones field teams already use."""

from __future__ import annotations

METHODS = {
    "transecto": "Transecto",
    "playback_aves": "Playback aves",
    "playback_anfibios": "Playback anfibios",
    "camara_trampa": "Cámara trampa",
    "trampa_sherman": "Trampas Sherman",
    "songmeter": "Grabadora acústica",
    "transito_aereo": "Tránsito aéreo",
    "transito_aereo_nocturno": "Tránsito aéreo nocturno (MTAN)",
    "punto_conteo": "Punto de conteo",
    "atropello": "Atropello",
    "registro_oportunista": "Registro oportunista",
    "otro": "Otro",
}
OPPORTUNISTIC = "registro_oportunista"
DISTANCE_METHODS = ["transecto", "registro_oportunista"]
TRAP_METHODS = ["camara_trampa", "trampa_sherman"]
DURATION_METHODS = [
    "punto_conteo", "playback_aves", "playback_anfibios",
    "transito_aereo", "transito_aereo_nocturno", "songmeter",
]
FLIGHT_METHODS = ["transito_aereo", "transito_aereo_nocturno"]
MACHINE_METHODS = ["camara_trampa", "songmeter"]
OWN_SHEET_METHODS = FLIGHT_METHODS + ["trampa_sherman", "camara_trampa"]

# How a method is named inside a sentence.
METHOD_PHRASES = {
    "transecto": "transecto",
    "playback_aves": "playback de aves",
    "playback_anfibios": "playback de anfibios",
    "camara_trampa": "revisión de cámara trampa",
    "trampa_sherman": "trampeo Sherman",
    "songmeter": "monitoreo acústico",
    "transito_aereo": "tránsito aéreo",
    "transito_aereo_nocturno": "tránsito aéreo nocturno",
    "punto_conteo": "punto de conteo",
    "atropello": "registro de atropello",
    "registro_oportunista": "registro oportunista",
}

RECORD_TYPES = [
    "Individuo", "Vocalización", "Huella", "Fecas", "Madriguera", "Cururera",
    "Plumas", "Muda", "Huesos", "Nido", "Egagrópila", "Registro de audio", "Otro",
]
RECORD_TYPES_BY_METHOD = {
    "trampa_sherman": ["Individuo"],
    "camara_trampa": ["Individuo", "Huella", "Otro"],
    "songmeter": ["Registro de audio", "Vocalización"],
    "playback_aves": ["Vocalización", "Individuo"],
    "playback_anfibios": ["Vocalización", "Individuo"],
    "transito_aereo": ["Individuo"],
    "transito_aereo_nocturno": ["Individuo", "Vocalización"],
    "atropello": ["Individuo"],
    "punto_conteo": ["Individuo", "Vocalización"],
}
# Evidence that stays at a fixed point of the landscape.
FIXED_EVIDENCE = [
    "Fecas", "Huella", "Madriguera", "Cururera", "Nido", "Huesos", "Egagrópila", "Muda", "Plumas",
]
INDIRECT_RECORD_TYPES = FIXED_EVIDENCE + ["Registro de audio"]

THREAT_LABELS = {
    "EX": "Extinta",
    "EW": "Extinta en estado silvestre",
    "RE": "Extinta regionalmente",
    "CR": "En peligro crítico",
    "EN": "En peligro",
    "VU": "Vulnerable",
    "NT": "Casi amenazada",
    "LC": "Preocupación menor",
    "DD": "Datos insuficientes",
    "NE": "No evaluada",
}
THREATENED_CODES = ["EX", "EW", "RE", "CR", "EN", "VU"]
RED_LIST_CODES = list(THREAT_LABELS) + ["CR-R", "EN-R", "VU-R", "NT-R", "LC-R"]
RED_LIST_THREATENED = ["CR", "EN", "VU", "CR-R", "EN-R", "VU-R"]
LOW_MOBILITY_ORDERS = ["Rodentia", "Didelphimorphia", "Microbiotheria", "Soricomorpha"]

CARDINALS = ["N", "NE", "E", "SE", "S", "SO", "O", "NO"]
SEASON_BY_MONTH = {12: "Verano", 1: "Verano", 2: "Verano", 3: "Otoño", 4: "Otoño", 5: "Otoño",
                   6: "Invierno", 7: "Invierno", 8: "Invierno"}
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto",
          "septiembre", "octubre", "noviembre", "diciembre"]

# Fields a survey profile may ask for, with their labels.
FIELD_LABELS = {
    "eventDate": "Fecha", "eventTime": "Hora", "station": "Estación", "method": "Metodología",
    "recordedBy": "Observador", "weather": "Clima", "taxon": "Especie", "trapNumber": "N° de trampa",
    "reproductiveCondition": "Condición reproductiva",
    "flightHeightReference": "Referencia de altura", "flightType": "Tipo de vuelo",
    "timeBlock": "Bloque horario",
    "recordType": "Tipo de registro", "individualCount": "Abundancia", "sex": "Sexo",
    "lifeStage": "Estado de desarrollo", "organismCondition": "Estado del organismo",
    "behaviour": "Comportamiento", "notes": "Observaciones", "photos": "Fotografías",
    "occurrenceCoordinates": "Coordenadas del avistamiento",
    "flightDirection": "Dirección de vuelo", "flightHeight": "Altura de vuelo",
    "flightOrigin": "Origen del vuelo", "flightDestination": "Destino del vuelo",
    "playbackResponse": "Respuesta al playback",
    "effort": "Esfuerzo de muestreo", "conditions": "Condiciones ambientales",
    "detectionDistance": "Distancia de detección", "organismId": "Código del individuo",
}
EVENT_LEVEL_FIELDS = ["eventDate", "eventTime", "station", "method", "recordedBy", "weather"]
REQUIREMENT_RANK = {"hidden": 0, "optional": 1, "recommended": 2, "required": 3}
