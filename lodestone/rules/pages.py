"""Dictionaries of the page parser."""

# Fixed values.
KEY_LINKS = [
    "contact", "contacto", "about", "nosotros", "equipo", "careers", "trabajo", "empleo", "services", "servicios", "pricing", "precios", "book",
    "booking", "reserv", "locations", "ubicaciones",
]
ADDRESS_PLACES = [
    " argentina", " madrid", " mexico", " méxico", " españa", " spain", " buenos aires", " barcelona", " valencia", " cdmx", " ciudad de mexico",
    " ciudad de méxico",
]
CALLS_TO_ACTION = {
    "booking": ["book", "booking", "reserve", "reservar", "reserva", "agenda", "agendar", "cita"],
    "contact_form": ["contact", "contacto", "habla", "hablemos", "escribenos", "escríbenos"],
    "whatsapp": ["whatsapp", "wa.me", "api.whatsapp.com"],
    "call": ["call", "llamar", "telefono", "teléfono"],
    "quote": ["quote", "cotiza", "cotizar", "presupuesto"],
    "signup": ["signup", "sign up", "registrate", "regístrate", "suscribete", "suscríbete"],
}
REFERENCE_PAGES = ["enciclopedia", "definicion", "definición", "concepto", "wikipedia", "diccionario"]
PLATFORMS = {
    "instagram": ["instagram.com"],
    "tiktok": ["tiktok.com"],
    "linkedin": ["linkedin.com"],
    "facebook": ["facebook.com"],
    "twitter": ["twitter.com", "x.com"],
}
EMAIL_BLOCKLIST = ["example.com", "yourdomain", "domain.com", "email.com", "test.com", "localhost"]
NODE_TYPES = ["localbusiness", "organization", "medicalbusiness", "dentist", "physician", "attorney", "store", "postaladdress"]
