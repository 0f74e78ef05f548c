"""Dictionaries of the quality gate."""

# Fixed values.
LANGUAGES = {
    "es": [" el ", " la ", " clinica ", " contacto ", " servicios ", " nosotros "],
    "en": [" the ", " contact ", " services ", " about ", " booking "],
    "pt": [" o ", " a ", " servicos ", " serviços ", " contato "],
}
STOPWORDS = [
    "de", "la", "el", "y", "para", "con", "una", "que", "los", "las", "por", "our", "your", "the", "and", "for", "with", "from", "this", "that",
    "site", "home", "about", "contact", "servicios", "service", "services", "clinica", "clinic",
]
STRONG_SOURCES = ["address", "map", "phone_prefix", "tld"]
MEDIUM_SOURCES = ["area_served", "postal_address_country", "title", "description", "discovery_title", "discovery_snippet"]
STREETS = [
    "calle", "avenida", "av", "street", "st", "road", "rd", "plaza", "paseo", "carrera", "camino", "suite", "ste", "oficina", "office", "local",
    "piso",
]
LOCATION_NOISE = [
    "tel", "telefono", "telefono:", "teléfono", "phone", "whatsapp", "horario", "horarios", "hours", "lunes", "martes", "miercoles", "miércoles",
    "jueves", "viernes", "sabado", "sábado", "domingo", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
]
GENERIC_MAIL = ["gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "icloud.com", "proton.me", "protonmail.com", "live.com"]
SECOND_LEVEL = ["com", "net", "org", "gov", "edu", "co"]
SOURCE_CONFIDENCE = {
    "structured_data": 'high',
    "mailto_link": 'high',
    "tel_link": 'high',
    "visible_text": 'medium',
    "metadata_list": 'medium',
    "html_form": 'medium',
    "whatsapp_link": 'medium',
    "booking_link": 'medium',
    "unknown": 'medium',
}
CONFIDENCE_SCORE = {"low": 0.35, "medium": 0.65, "high": 0.9}
TARGET_ECOMMERCE = ["ecommerce", "tienda online", "shopify"]
TARGET_EDUCATION = ["academia online", "cursos online", "escuela online", "formacion online", "productos digitales", "infoproductos"]
SERVICE_PROVIDER = [
    "asesoria", "asesoría", "consultoria", "consultoría", "consultor", "consultora", "coach", "coaching", "mentor", "mentoria", "mentoría", "agencia",
    "servicios para empresas", "presupuesto",
]
ECOMMERCE = [
    "tienda online", "ecommerce", "shopify", "carrito", "checkout", "comprar", "añadir al carrito", "anadir al carrito", "coleccion", "colección",
    "catalogo", "catálogo",
]
EDUCATION = [
    "academia", "curso", "cursos", "masterclass", "programa", "formacion", "formación", "alumnos", "inscripcion", "inscripción", "campus", "clases",
]
PRODUCT_PAGE = [
    "añadir al carrito", "anadir al carrito", "carrito", "sku", "referencia", "serie completa", "distribuidor oficial", "catalogo", "catálogo",
]
