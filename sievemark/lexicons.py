"""Versioned word lists and constants. Fixed values throughout: results depend on their exact content and order."""

# --- page audit: alternatives of case-insensitive word patterns (fixed values) ---
PAGE_COMMERCIAL = "product|products|shop|store|service|services|course|courses|booking|appointment|appointments|consultation|consultations|programme|program|formation|formations|produit|produits|service|services|cours|r[ée]servation|rendez[- ]vous|tarif|tarifs|offre|offres|abonnement|subscription"
PAGE_CTA = "add to cart|buy now|buy|order|checkout|book now|book|reserve|request a quote|contact us|sign up|subscribe|ajouter au panier|acheter|commander|r[ée]server|prendre rendez[- ]vous|demander un devis|obtenir un devis|contactez[- ]nous|nous contacter|s['’]inscrire|inscription|je m['’]inscris|appeler|appelez[- ]nous"
PAGE_BOOKING = "book now|book|reserve|appointment|r[ée]server|r[ée]servation|prendre rendez[- ]vous|calendly"
PAGE_QUOTE = "request a quote|quote|demander un devis|obtenir un devis|devis"
PAGE_PURCHASE = "add to cart|buy now|buy|order|checkout|ajouter au panier|acheter|commander|panier|paiement"
PAGE_CONTACT = "contact us|contactez[- ]nous|nous contacter|call us|appelez[- ]nous|appeler|whatsapp"
PAGE_AVAILABILITY = "in stock|out of stock|available|availability|opening hours|open |en stock|rupture|disponible|disponibilit[ée]|horaires|ouvert|cr[ée]neau|places restantes"
PAGE_PAYMENT = "visa|mastercard|paypal|payment|paiement|carte bancaire|apple pay|stripe"
PAGE_AREA = "shipping|delivery|deliver|service area|address|livraison|livrons|zone desservie|adresse|retrait|click and collect"
PAGE_JS_REQUIRED = "javascript is disabled|javascript required|enable javascript|please enable javascript|activez javascript|javascript d[ée]sactiv[ée]|requires javascript"
PAGE_BOT_BLOCK = "verify you are human|security check|access denied|unusual traffic|captcha|cf-chl-|just a moment|checking your browser|robot check|v[ée]rifiez que vous [êe]tes humain"

# --- crawl (fixed values) ---
RELEVANT_TOKENS = (
    "product", "produit", "service", "pricing", "price", "tarif", "shop", "boutique", "faq", "help", "aide", "shipping", "delivery", "livraison", "return", "refund",
    "retour", "annulation", "cancel", "booking", "reservation", "réservation", "contact", "about", "apropos", "qui-sommes", "payment", "paiement", "legal", "mentions",
)
EXCLUDED_TOKENS = ("/login", "/signin", "/account", "/admin", "/cart", "/checkout", "/wp-admin")
NON_HTML_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".css", ".js", ".xml", ".pdf", ".zip", ".mp4", ".webm", ".woff", ".woff2")
JS_APP_MARKERS = (r"""id=["'](?:root|app|__next|__nuxt)["']""", "/_next/", "__NEXT_DATA__", "webpack", "vite", "ng-version=", "data-reactroot")

# --- site audit: phrases of facts, by field (fixed values) ---
FACT_PHRASES = {
    "availability": ("en stock", "in stock", "disponible", "availability", "rupture", "out of stock", "créneau", "slot"),
    "service_area": ("zone desservie", "zones desservies", "nous intervenons", "livraison en", "livrons", "delivery area", "service area", "available in"),
    "shipping": ("livraison", "expédition", "shipping", "delivery", "retrait", "click and collect"),
    "payment": ("paiement", "payment", "visa", "mastercard", "paypal", "apple pay", "virement", "carte bancaire"),
    "returns": ("retour", "remboursement", "refund", "return policy", "returns", "droit de rétractation"),
    "cancellation": ("annulation", "annuler", "cancellation", "cancel booking"),
    "faq": ("faq", "questions fréquentes", "frequently asked questions"),
    "booking_process": ("réserver", "reservation", "réservation", "book now", "book a", "prendre rendez-vous", "appointment"),
    "quote_process": ("devis", "quote", "estimate", "demander une offre", "request a proposal"),
    "purchase_process": ("ajouter au panier", "add to cart", "acheter", "buy now", "commander", "checkout", "s'inscrire", "je veux", "rejoindre le programme", "accès immédiat"),
    "contact_process": ("contact", "nous appeler", "call us", "email us", "formulaire"),
    "hours": ("horaires", "opening hours", "ouvert", "open monday", "lundi", "monday"),
    "address": ("adresse", "address", "nous trouver", "find us"),
}
LEGAL_CONTEXT = {
    "booking": ("se reserve le droit", "reserve le droit", "reserver l acces", "acces reserve", "categorie reservee", "droits reserves"),
    "returns": ("se retourner contre", "retour vers soi", "retour d experience", "retours d experience", "retour a la page", "en retour de"),
    "quote": ("ta devise", "ma devise", "notre devise", "votre devise", "quelle devise"),
}
FACT_CONTEXT = {"quote_process": "quote", "booking_process": "booking", "returns": "returns"}
FACT_FIELDS = (
    "business_name", "business_description", "activity_market", "contact_email", "contact_phone", "address", "service_area", "pricing", "availability", "shipping", "payment",
    "returns", "commercial_status", "cancellation", "faq", "purchase_process", "booking_process", "quote_process", "contact_process", "opening_hours", "structured_data",
)
COMMERCIAL_STATUS = (
    ("permanently_closed", ("fermeture definitive", "definitivement ferme", "permanently closed")),
    ("temporarily_closed", ("fermeture temporaire", "temporairement ferme", "actuellement temporairement ferme", "temporarily closed")),
    ("unavailable", ("indisponible", "non disponible")),
    ("seasonal", ("ouverture saisonniere", "selon la saison", "seasonal")),
    ("open", ("ouvert 7j", "ouvert du lundi", "open daily")),
)

# --- offers (fixed values) ---
OFFER_TYPES = (
    ("reservation", ("reservation", "reserver", "booking", "rendez vous", "rdv", "appointment", "consultation")),
    ("formation", ("formation", "formations", "cours", "course", "programme", "programmes", "program", "academy", "academie")),
    ("product", ("produit", "produits", "product", "products", "boutique", "shop", "store", "ebook", "livre", "livres", "book", "pains", "viennoiseries", "patisseries", "confiseries")),
    ("service", ("service", "services", "offre", "offres", "offer", "tarif", "tarifs", "pricing", "coaching", "accompagnement", "soin", "traiteur")),
)
COMMERCIAL_TERMS = (
    "formation", "programme", "consultation", "reservation", "rendez vous", "service", "produit", "ebook", "livre", "atelier", "coaching", "accompagnement", "soin",
    "acces immediat", "paiement securise", "inscription", "tarif", "commande", "devis",
)
CTA_TERMS = (
    "acheter", "buy", "commander", "order", "ajouter au panier", "add to cart", "s inscrire", "inscription", "reserver", "book", "prendre rendez vous", "demander un devis",
    "request a quote", "obtenir un devis", "je veux", "rejoindre", "rejoins", "acceder", "commencer", "obtiens", "obtenir", "contactez", "contact us",
)
STRONG_CTA = ("ajouter au panier", "add to cart", "acheter", "commander", "buy now", "reserver maintenant", "demander un devis")
CONTEXT_CTA = ("formation", "ebook", "programme", "consultation", "rendez vous", "offre", "devis")
PAGE_KINDS = (
    ("legal", ("mentions legales", "legal", "cgu", "cgv", "privacy", "confidentialite", "politique")),
    ("portfolio", ("realisation", "realisations", "portfolio", "projet", "projets", "case study", "etude de cas")),
    ("article", ("blog", "article", "actualite", "actualites", "news", "conseil", "conseils", "journal")),
    ("event", ("event", "events", "evenement", "evenements", "agenda", "salon")),
    ("testimonial", ("temoignage", "temoignages", "avis clients", "success story")),
    ("category", ("collection", "collections", "categorie", "categories", "univers", "rayon", "faq", "foire aux questions")),
)
GENERAL_KIND = "offer_or_general"
AVAILABILITY_LABELS = (
    ("temporarily_closed", ("fermeture temporaire", "temporairement ferme", "temporarily closed")),
    ("permanently_closed", ("fermeture definitive", "definitivement ferme", "permanently closed")),
    ("unavailable", ("indisponible", "non disponible")),
    ("seasonal", ("ouverture saisonniere", "selon la saison", "seasonal")),
    ("in_stock", ("en stock", "in stock")),
    ("out_of_stock", ("rupture", "out of stock")),
    ("immediate_access", ("acces immediat", "access immediate")),
    ("open", ("ouvert 7j", "ouvert du lundi", "open daily")),
    ("available", ("disponible", "places disponibles", "creneau disponible")),
)
FREQUENCY_LABELS = (("monthly", ("par mois", "mensuel")), ("yearly", ("par an", "annuel")), ("one_time", ("paiement unique",)))
NON_OFFER_PRICE = ("budget", "chiffre d affaires", "economies realisees", "montant des travaux")
STRUCTURAL_WIDGET = ("related", "recommended", "recommendation", "similar", "upsell", "cross sell", "recently viewed", "you may also", "produits associes")
HEADING_WIDGET = ("produits associes", "vous aimerez", "a decouvrir aussi", "filtrer par", "menu")
HEADING_PROCESS = ("etape", "comment ca marche", "deroulement", "notre processus", "echange diagnostic", "devis planning", "livraison garanties")
HEADING_INFORMATION = ("notre equipe", "nos valeurs", "nos engagements", "informations pratiques", "questions frequentes", "contact", "service client")
HEADING_CATEGORY = ("nos produits", "nos services", "les tarifs", "les cours", "categories")
BLOCK_BOOKING = ("reserver", "prendre rendez vous", "book now", "reservation en ligne")
BLOCK_QUOTE = ("demander un devis", "obtenir un devis", "request a quote")
PLAIN_HEADINGS = ("nos engagements", "notre equipe", "questions frequentes", "foire aux questions")
DROPPED_ROLES = ("recommendation_widget", "article", "event", "portfolio", "testimonial", "legal", "process_step", "informational")
PROCESS_NAMES = ("echange diagnostic", "devis planning", "realisation pilotee", "livraison garanties", "prise de contact", "analyse du besoin", "validation du devis", "suivi du projet")
INFORMATIVE_NAMES = ("innovation", "disponibilite", "rigueur", "durabilite", "nos engagements", "notre equipe", "nos valeurs", "pourquoi nous choisir", "garanties")
CATEGORY_NAMES = ("produits associes", "informations produit", "l essentiel", "notre boutique", "meilleures ventes", "favoris", "les cours", "les tarifs", "un espace a decouvrir")
INFORMATIVE_PREFIXES = ("inscrivez vous a notre newsletter", "pourquoi visiter", "une boutique a votre service", "venir a la boutique", "mais aussi des cours")
GATEWAY_NAMES = ("reserver un cours", "reserver une seance decouverte")

# --- profiles, rules, recommendations (fixed values) ---
NOT_APPLICABLE = {
    "ecommerce": ("booking_process", "quote_process", "opening_hours"),
    "service_with_booking": ("shipping", "returns", "purchase_process"),
    "service_with_quote_or_lead": ("shipping", "returns", "availability", "payment", "cancellation", "purchase_process", "booking_process"),
    "local_business": ("shipping", "returns"),
    "informational": ("pricing", "availability", "shipping", "payment", "returns", "cancellation", "purchase_process", "booking_process", "quote_process"),
}
PURCHASE_CTA_PARTS = ("acheter", "commander", "je veux", "inscri", "rejoindre", "accéder", "buy", "order")
SERVICE_WORDS = ("service", "conseil", "cabinet", "agence", "consult", "accompagnement", "studio")
#: rule, family, points
RULES = (
    ("DISC.ACCESS.001", "ai_discoverability", 20), ("DISC.ROBOTS.002", "ai_discoverability", 10), ("DISC.INDEX.003", "ai_discoverability", 15),
    ("DISC.CANONICAL.004", "ai_discoverability", 10), ("DISC.SITEMAP.005", "ai_discoverability", 10), ("DISC.LINKS.006", "ai_discoverability", 20),
    ("DISC.META.007", "ai_discoverability", 15),
    ("UNDR.IDENTITY.001", "understanding", 15), ("UNDR.ACTIVITY.002", "understanding", 10), ("UNDR.OFFERS.003", "understanding", 25),
    ("UNDR.PRICE.004", "understanding", 10), ("UNDR.AREA.005", "understanding", 10), ("UNDR.SCHEMA.006", "understanding", 15),
    ("UNDR.CONSISTENCY.007", "understanding", 15),
    ("BUY.CONVERSION.001", "buyability", 30), ("BUY.PRICE.002", "buyability", 15), ("BUY.AVAILABILITY.003", "buyability", 10),
    ("BUY.AREA.004", "buyability", 10), ("BUY.PAYMENT.005", "buyability", 10), ("BUY.POLICY.006", "buyability", 10), ("BUY.MACHINE.007", "buyability", 15),
)
#: Rule, impact, title (which tells issues apart), kind; and a code of our own for what the owner must supply.
RECOMMENDATIONS = (
    ("UNDR.OFFERS.003", 100, "Offres insuffisamment explicites", "content", ("offer_details",)),
    ("BUY.CONVERSION.001", 98, "Parcours commercial introuvable", "content", ("purchase_steps",)),
    ("UNDR.PRICE.004", 94, "Information tarifaire absente", "commercial_information", ("price_model",)),
    ("BUY.PRICE.002", 94, "Prix ou devis indéterminable", "commercial_information", ("price_or_quote_rules",)),
    ("UNDR.AREA.005", 91, "Zone desservie inconnue", "commercial_information", ("served_areas",)),
    ("BUY.AREA.004", 91, "Éligibilité géographique inconnue", "commercial_information", ("served_areas",)),
    ("BUY.AVAILABILITY.003", 90, "Disponibilité inconnue", "commercial_information", ("availability_rule",)),
    ("UNDR.IDENTITY.001", 89, "Identité de l'entreprise ambiguë", "content", ("business_name",)),
    ("UNDR.ACTIVITY.002", 88, "Activité ou marché peu explicite", "content", ("activity_and_market",)),
    ("BUY.PAYMENT.005", 82, "Modalités de paiement inconnues", "commercial_information", ("payment_methods",)),
    ("BUY.POLICY.006", 80, "Politique commerciale manquante", "commercial_information", ("policy",)),
    ("UNDR.SCHEMA.006", 64, "Données structurées absentes", "structured_data", ()),
    ("BUY.MACHINE.007", 62, "Offre non structurée pour les machines", "structured_data", ()),
    ("DISC.ACCESS.001", 78, "Pages publiques difficilement accessibles", "technical", ()),
    ("DISC.ROBOTS.002", 55, "Exploration limitée", "technical", ()),
    ("DISC.INDEX.003", 58, "Pages déclarées non indexables", "technical", ()),
    ("DISC.CANONICAL.004", 42, "Canonicalisation incomplète", "technical", ()),
    ("DISC.SITEMAP.005", 38, "Sitemap non découvert", "technical", ()),
    ("DISC.LINKS.006", 60, "Pages importantes peu découvrables", "technical", ()),
    ("DISC.META.007", 35, "Metadata descriptive incomplète", "content", ()),
)
#: template, category, pattern on the action's title; the first is reached by its own rule only
REMEDIATIONS = (
    ("commercial_accessibility", "buyability", None),
    ("pricing", "missing_or_unclear_pricing", "price|pricing|cost|fee|rate"),
    ("cta", "weak_commercial_next_step", "cta|call.to.action|actionability|next step|buy|contact"),
    ("booking", "booking_path", "book|booking|appointment|schedule"),
    ("quote", "quote_request_path", "quote|request|enquir|inquir"),
    ("identity", "business_identity_contact", "identity|contact|business name|location|address|phone"),
    ("schema", "structured_data", "schema|structured data|structured signal|markup"),
    ("offer", "offer_detail", "offer|service|product|detail|description"),
    ("availability", "commercial_availability", "availability|available|timing|status|hours"),
)
REMEDIATION_BROAD = "make key commercial information agent-accessible|commercial.accessib|agent.accessible"
