"""Dictionaries of query synthesis."""

# Fixed values.
NEGATIVES = ["-blog", "-ideas", "-noticias", "-prensa", "-informe", "-report", "-revista", "-g2", "-pinterest", "-linkedin"]
PROVIDER_NEGATIVES = [
    "-asesoria", "-asesoría", "-consultoria", "-consultoría", "-consultor", "-consultora", "-coach", "-coaching", "-mentor", "-mentoria", "-mentoría",
    "-agencia", "-freelance", "-freelancer",
]
PREFIXES = ["empresas ", "marcas ", "negocios ", "sitios "]
PLATFORM_HINTS = ["instagram", "tiktok", "link in bio", "linktree", "reels", "shorts"]
COMMERCIAL_HINTS = ["marca personal", "coach", "coaches", "ecommerce", "tienda online", "agencia", "curso", "cursos", "infoproductos"]
VARIANTS = {
    "ecommerce": ["ecommerce", "tienda online", "shopify"],
    "tienda online": ["tienda online", "ecommerce", "shopify"],
    "shopify": ["shopify", "tienda online", "ecommerce"],
    "academia online": ["academia online", "cursos online", "escuela online", "formacion online"],
    "academias online": ["academia online", "cursos online", "escuela online", "formacion online"],
    "cursos online": ["cursos online", "academia online", "escuela online"],
    "escuela online": ["escuela online", "academia online", "cursos online"],
    "productos digitales": ["productos digitales", "infoproductos", "cursos online"],
    "infoproductos": ["infoproductos", "productos digitales", "cursos online"],
}
LANGUAGE_HINTS = {
   
    "es": {'official': 'sitio oficial', 'contact': 'contacto', 'services': 'servicios', 'commercial': ['empresa', 'negocio', 'servicios'], 'locations': ['ubicaciones', 'sedes']},
    "en": {'official': 'official site', 'contact': 'contact', 'services': 'services', 'commercial': ['business', 'company', 'services'], 'locations': ['locations', 'branches']},
    "pt": {'official': 'site oficial', 'contact': 'contato', 'services': 'servicos', 'commercial': ['empresa', 'negocio', 'servicos'], 'locations': ['localizacoes', 'unidades']},
}
