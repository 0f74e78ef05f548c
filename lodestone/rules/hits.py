"""Dictionaries of the search-hit classifier."""

# Fixed values.
BLOCKED = [
    "mercadolibre", "youtube", "reddit.com", "redd.it", "twitter", "x.com", "whatsapp.com", "web.whatsapp.com", "infoisinfo", "habitissimo",
    "foursquare", "google.com", "googleusercontent",
]
REFERENCE_HOSTS = ["wikipedia.org", "wiktionary.org", "concepto.de", "dle.rae.es", "rae.es", "britannica.com", "dictionary.com"]
NEWS_HOSTS = ["marketwatch.com", "forbes.com", "bloomberg.com", "cnn.com", "elpais.com", "expansion.com"]
FINANCE_HOSTS = ["marketwatch.com", "investing.com", "finance.yahoo.com", "yahoo.com/finance", "morningstar.", "tradingview.com"]
ENTERPRISE_HOSTS = ["amazon.", "microsoft.", "meta.com", "apple.com", "ibm.com", "salesforce.com", "hubspot.com", "adobe.com"]
SEED_HOSTS = ["doctoralia", "topdoctors", "paginasamarillas", "guiatelefonica", "yellowpages", "yelp", "tripadvisor"]
SOCIAL_HOSTS = ["linkedin.com", "facebook.com", "instagram.com", "tiktok.com", "youtube.com", "twitter.com", "x.com"]
OFFICIAL_LABELS = ["sitio web", "website", "web oficial", "official site", "pagina web", "página web", "visitar web", "visitar sitio", "homepage"]
EDITORIAL_PATHS = [
    "/blog/", "/ideas/", "/noticias/", "/news/", "/prensa/", "/press/", "/categories/", "/category/", "/guia/", "/guía/", "/article/", "/articulo/",
    "/artículos/", "/informe", "/informes/", "/report/", "/reports/", "/study/", "/studies/", "/insights/", "/tag/", "/wiki/",
]
EDITORIAL_TITLES = [
    "100 ideas", "ideas de negocio", "qué vender", "que vender", "guia", "guía", "categorías", "categories", "tendencias", "informe", "informes",
    "report", "reports", "estudio", "estudios", "prensa", "press", "newsroom", "estadisticas", "estadísticas", "mejores", "top ", "lista de",
    "enciclopedia",
]
PRODUCT_PATHS = ["/product/", "/products/", "/producto/", "/productos/"]
PRODUCT_WORDS = [
    "añadir al carrito", "anadir al carrito", "carrito", "sku", "referencia", "serie completa", "distribuidor oficial", "catalogo", "catálogo",
]
INSTITUTIONS = [
    "ministerio", "gobierno", "ayuntamiento", "diputacion", "diputación", "comision nacional", "comisión nacional", "federacion", "federación",
    "fundacion", "fundación", "universidad",
]
POST_PATHS = ["/p/", "/reel/", "/reels/", "/tv/", "/explore/", "/hashtag/", "/share", "/video/", "/photo/"]
SHARE_MARKS = ["?hl=", "/share?", "sharer.php", "/intent/"]
PROFILE_HINTS = ["link in bio", "dm", "escribeme", "escríbeme", "agenda", "book", "consulta", "servicios", "services", "shop"]
COMMERCIAL = [
    "coach", "coaches", "marca personal", "ecommerce", "tienda online", "agencia", "estudio", "editor", "filmmaker", "creator", "creador", "curso",
    "infoproducto",
]
REFERENCE_WORDS = ["enciclopedia", "definicion", "definición", "concepto", "meaning", "definition"]
ENTERPRISE_WORDS = ["fortune 500", "nasdaq", "nyse", "earnings", "investor relations"]
