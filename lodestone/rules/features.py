"""Dictionaries of the heuristic features."""

# Fixed values.
TECHNOLOGIES = {
    "WordPress": ["wp-content", "wp-includes", 'generator" content="wordpress', "wordpress"],
    "WooCommerce": ["woocommerce"],
    "Shopify": ["cdn.shopify", "shopify.com", "shopify-section"],
    "Wix": ["wixstatic.com", "wix.com"],
    "Webflow": ["webflow", "data-wf-page"],
    "Elementor": ["elementor"],
    "React": ["data-reactroot", "_react_", "react-dom"],
    "Next.js": ["_next/static", "__next"],
    "Google Analytics": ["google-analytics.com/analytics.js", "gtag(", "googletagmanager.com/gtag"],
    "Google Tag Manager": ["googletagmanager.com/gtm.js", "gtm.start"],
    "Meta Pixel": ["fbevents.js", "fbq("],
    "HubSpot": ["js.hs-scripts.com", "hubspot"],
    "Stripe": ["js.stripe.com", "stripe.com/payments"],
}
LANGUAGES = {
    "es": [" de ", " la ", " que ", " en ", " para ", " con ", " clinica ", " nosotros "],
    "en": [" the ", " and ", " for ", " with ", " services ", " about ", " contact "],
}
PRICING = ["precios", "pricing", "planes", "plan", "tarifas", "quote", "cotizacion"]
TESTIMONIALS = ["testimonios", "testimonial", "testimonials", "case study", "casos de exito", "clientes"]
PORTFOLIO = ["portfolio", "portafolio", "proyectos", "work", "casos", "portfolio"]
BOOKING = ["reserva", "reservas", "book", "booking", "agenda", "cita", "appointment", "schedule"]
BOOKING_PAINS = ["reserva", "reservas", "booking", "agenda", "cita", "appointment"]
BUSINESS_NODES = [
    "accountingservice", "attorney", "beautysalon", "dentalclinic", "dentist", "employmentagency", "financialservice", "localbusiness",
    "medicalbusiness", "medicalclinic", "organization", "professionalservice", "realestateagent", "store",
]
