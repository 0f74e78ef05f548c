"""Business taxonomy: type, top level, niche, category, keywords, schema types, in the order that decides ties."""

# Fixed values.
TAXONOMY = [
    ("dental_clinic", "health", "Dental", "Clinica dental",
     ["dental clinic", "clinica dental", "dental", "dentist", "dentista", "ortodoncia", "implantes", "odontologia", "odontologia"],
     ["dentalclinic", "dentist"]),
    ("medical_clinic", "health", "Clinica", "Clinica",
     ["clinica", "clinic", "medical", "medico", "médico", "salud", "health", "doctor"],
     ["medicalbusiness", "medicalclinic", "physician"]),
    ("veterinary_clinic", "health", "Veterinaria", "Clinica veterinaria",
     ["veterinaria", "veterinary", "vet", "mascotas", "pet clinic"],
     []),
    ("beauty_salon", "beauty", "Belleza", "Salon de belleza",
     ["beauty", "belleza", "spa", "estetica", "estética", "salon", "salon de belleza"],
     ["beautysalon", "healthandbeautybusiness"]),
    ("law_firm", "legal", "Legal", "Estudio juridico",
     ["abogado", "abogados", "legal", "law firm", "attorney", "bufete", "juridico", "jurídico"],
     ["attorney", "legalservice"]),
    ("accounting_firm", "finance", "Contabilidad", "Estudio contable",
     ["accounting", "accountant", "contador", "contable", "bookkeeping"],
     ["accountingservice"]),
    ("financial_service", "finance", "Finanzas", "Servicio financiero",
     ["financial", "finanzas", "seguros", "insurance", "investment", "credito", "crédito"],
     ["financialservice"]),
    ("real_estate_agency", "real_estate", "Inmobiliaria", "Agencia inmobiliaria",
     ["real estate", "inmobiliaria", "propiedades", "realtor", "property"],
     ["realestateagent"]),
    ("restaurant", "food_hospitality", "Restaurantes", "Restaurante",
     ["restaurant", "restaurante", "cafe", "cafeteria", "bar", "bistro", "menu"],
     []),
    ("retail_store", "retail", "Retail", "Tienda",
     ["tienda", "store", "shop", "retail", "ecommerce", "e-commerce"],
     ["store"]),
    ("marketing_agency", "professional_services", "Marketing", "Agencia de marketing",
     ["marketing agency", "agencia de marketing", "seo agency", "branding", "performance marketing", "paid media"],
     ["employmentagency"]),
    ("design_studio", "professional_services", "Diseno", "Estudio de diseno",
     ["design studio", "estudio de diseno", "graphic design", "creative studio", "branding studio", "diseno grafico"],
     []),
    ("software_agency", "technology", "Software", "Agencia de desarrollo",
     ["software agency", "web development", "desarrollo web", "app development", "software house", "digital product studio"],
     []),
    ("consultant_service", "professional_services", "Consultoria", "Consultoria",
     ["consultor", "consultora", "consulting", "consultancy", "advisor", "asesoria", "asesoría"],
     []),
    ("professional_service", "professional_services", "Servicios profesionales", "Servicio profesional",
     ["professional service", "servicios profesionales", "estudio", "agency", "agencia"],
     ["professionalservice", "organization"]),
    ("local_business", "general_services", "Negocio local", "Negocio local",
     ["local business", "negocio local", "servicios", "empresa"],
     ["localbusiness", "homeandconstructionbusiness", "automotivbusiness"]),
    ("directory_listing", "marketplace", "Directorio", "Directorio",
     ["directory", "directorio", "listado", "listing"],
     ["itemlist", "collectionpage", "searchresultspage"]),
    ("aggregator_platform", "marketplace", "Comparador", "Comparador",
     ["comparador", "compare", "comparison", "ranking", "top 10", "reviews"],
     []),
    ("marketplace_platform", "marketplace", "Marketplace", "Marketplace",
     ["marketplace", "vendors", "seller", "multiple providers"],
     []),
    ("media_publisher", "media", "Media", "Medio",
     ["news", "magazine", "revista", "press", "publisher", "newsroom"],
     []),
    ("editorial_content", "media", "Editorial", "Articulo editorial",
     ["blog", "article", "articulo", "post", "noticias"],
     ["article", "blogposting", "newsarticle", "reportagearticle"]),
    ("association_org", "association", "Asociacion", "Asociacion",
     ["association", "asociacion", "asociación", "camara", "cámara", "federacion", "federación"],
     []),
    ("unknown", "unknown", "Desconocido", "Desconocido",
     [],
     []),
]
#: Entity types that decide the type outright, and hints that tell agencies apart.
BY_ENTITY = {"directory": "directory_listing", "aggregator": "aggregator_platform", "marketplace": "marketplace_platform", "media": "media_publisher", "blog_post": "editorial_content", "association": "association_org", "consultant": "consultant_service"}
AGENCIES = {"marketing_agency": ["marketing", "seo", "ads", "paid media", "growth"], "design_studio": ["design", "diseño", "diseno", "branding", "creative"], "software_agency": ["software", "development", "desarrollo", "app", "web"]}
