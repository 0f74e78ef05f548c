"""Dictionaries of the entity classifier."""

# Fixed values.
TYPES = ["direct_business", "directory", "aggregator", "marketplace", "media", "blog_post", "association", "agency", "consultant", "unknown"]
TARGETS = ["direct_business", "agency", "consultant"]
NON_TARGETS = ["directory", "aggregator", "marketplace", "media", "blog_post", "association"]
BUSINESS_NODES = [
    "accountingservice", "attorney", "automotivbusiness", "beautysalon", "dentalclinic", "dentist", "employmentagency", "financialservice",
    "healthandbeautybusiness", "homeandconstructionbusiness", "legalservice", "localbusiness", "medicalbusiness", "medicalclinic", "organization",
    "professionalservice", "realestateagent", "store",
]
ARTICLE_NODES = ["article", "blogposting", "newsarticle", "reportagearticle"]
LISTING_NODES = ["collectionpage", "itemlist", "searchresultspage"]
AGENCY = ["agency", "agencia", "creative studio", "digital studio", "estudio", "web studio", "marketing agency", "seo agency", "design agency"]
CONSULTANT = ["consultant", "consultancy", "consulting", "consultor", "consultora", "advisor", "asesor", "asesoria"]
ASSOCIATION = [
    "association", "asociacion", "asociación", "chamber", "camara", "cámara", "federation", "federacion", "federación", "guild", "society",
    "colegio profesional",
]
DIRECTORY = ["directory", "directorio", "listing", "listado", "business directory", "company directory", "provider directory", "find a", "encuentra"]
AGGREGATOR = [
    "best", "top ", "top-", "compare", "comparison", "alternatives", "ranking", "rankings", "review", "reviews", "mejores", "comparador",
    "comparativa",
]
MARKETPLACE = ["marketplace", "vendors", "seller", "sellers", "buy and sell", "compra y vende", "multiple providers"]
MEDIA = ["news", "newspaper", "newsroom", "press", "magazine", "revista", "journal", "diario", "media"]
BLOG_PATHS = ["/blog", "/article", "/articles", "/post", "/posts", "/news", "/noticias"]
DIRECTORY_PATHS = ["/directory", "/directorio", "/listing", "/companies", "/empresas", "/providers"]
AGGREGATOR_PATHS = ["/best-", "/compare", "/comparador", "/ranking", "/reviews", "/top-"]
MARKETPLACE_PATHS = ["/marketplace", "/vendors", "/seller", "/tienda", "/shop"]
MEDIA_PATHS = ["/newsroom", "/press", "/revista", "/magazine"]
