"""Labelled exemplars of residue: messages that web servers, browsers, frameworks and templates are widely known to show."""

#: Exemplars by language and kind; names, numbers and addresses are left out. FIELD stands for an unfilled field.
FIELD = "fieldtoken"
EXEMPLARS: dict[str, dict[str, list[str]]] = {
    "": {
        "placeholder": [FIELD, "undefined", "null", "NaN", "object Object", "undefined null", "TODO", "TBD"],
        "filler": [
            "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
            "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
            "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
            "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
            "Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.",
            "Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.",
            "Massa vitae tortor condimentum lacinia quis vel eros donec ac odio tempor.",
            "Pulvinar elementum integer enim neque volutpat ac tincidunt vitae semper.",
            "Eget nullam non nisi est sit amet facilisis magna etiam tempor orci eu lobortis.",
            "Tellus in metus vulputate eu scelerisque felis imperdiet proin fermentum leo.",
            "Ornare arcu dui vivamus arcu felis bibendum ut tristique et egestas quis.",
        ],
        "error": [
            "Fatal error: Uncaught exception in on line",
            "Warning: cannot connect to database server",
            "Application error: a server side exception has occurred",
            "NullReferenceException: object reference not set to an instance of an object",
            "NullPointerException at",
            "Traceback most recent call last",
            "Stack trace",
            "Unhandled exception: null reference",
        ],
    },
    "en": {
        "error": [
            "Page not found", "Not Found", "Bad Gateway", "Service Unavailable", "Internal Server Error", "Gateway Timeout",
            "The requested URL was not found on this server.",
            "The page you requested could not be found.",
            "The page you are looking for might have been moved, renamed or deleted, or no longer exists.",
            "Sorry, we cannot find or open that page.",
            "Sorry, something went wrong.",
            "An unexpected error has occurred. The error has been logged and reported to our team under this number.",
            "The server encountered a problem or internal error and was unable to complete your request.",
            "Please try again later or go back to the start page or home page.",
            "The upstream server timed out while waiting for the request.",
            "There is nothing at this address any more.",
            "We are down for maintenance and expect to be back shortly in a few minutes.",
            "This site is currently undergoing scheduled maintenance. Please check back soon.",
            "This content is currently not available at the moment.",
            "The link you followed may be broken or has expired.",
            "This page does not exist.",
            "We could not load this content.",
        ],
        "access": [
            "Access denied", "Forbidden", "Loading", "Please wait", "Just a moment",
            "You do not have permission to view or access this page or resource on this server.",
            "Please verify that you are human and not a robot to continue.",
            "Confirm you are not a bot by completing the captcha.",
            "Checking your browser and connection before accessing the site, one moment please.",
            "Too many requests from your network address. Slow down and try again in a few seconds.",
            "Your session has expired. Please sign in or log in again to continue reading.",
            "You must be logged in to view this page.",
            "Loading, please wait while the page loads.",
            "Access to this page has been blocked.",
        ],
        "script": [
            "Please enable JavaScript to view this site.",
            "You need to enable JavaScript to run this app.",
            "JavaScript is disabled in your browser.",
            "This page needs or requires JavaScript. Switch scripts on in your browser settings and load or reload again.",
            "Your browser does not support or run scripts, so this content cannot be shown.",
            "Turn on JavaScript and cookies to continue or use this website.",
            "Enable scripts if the page takes longer.",
        ],
        "placeholder": [
            "Headline goes here", "Body copy text goes here", "Your content here", "Insert text here", "Your text goes here", "Title goes here",
            "Add a short description of your page here.", "Untitled page", "Untitled document", "Content coming soon", "Page text to follow", "Enter your heading here",
            "This is a sample text. Replace it with your own.", "Click here to edit this text.", "Placeholder text",
        ],
    },
    "de": {
        "error": [
            "Seite nicht gefunden", "Nicht gefunden", "Interner Serverfehler", "Fehler: Seite nicht gefunden",
            "Die angeforderte Seite konnte nicht gefunden werden.",
            "Die Seite existiert nicht mehr, wurde verschoben oder gelöscht.",
            "Es ist ein Fehler aufgetreten.",
            "Leider ist etwas schiefgelaufen. Der Vorgang wurde abgebrochen.",
            "Bitte versuchen Sie es später noch einmal.",
            "Unter dieser Adresse liegt oder befindet sich nichts mehr.",
            "Die Seite wird gerade gewartet und ist in wenigen Minuten wieder erreichbar. Bitte kommen Sie wieder.",
            "Dieser Inhalt ist derzeit nicht verfügbar.",
            "Ihre Anfrage konnte nicht verarbeitet werden.",
        ],
        "access": [
            "Zugriff verweigert", "Zugriff verweigert. Kennung", "Bitte warten", "Wird geladen",
            "Bitte warten Sie, die Seite wird geladen.",
            "Sie haben keine Berechtigung, diese Seite anzusehen.",
            "Bitte bestätigen Sie, dass Sie kein Roboter sind.",
            "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.",
            "Zu viele Anfragen. Bitte warten Sie einige Sekunden.",
        ],
        "script": [
            "Bitte aktivieren Sie JavaScript in Ihrem Browser.",
            "Bitte schalten Sie JavaScript ein, um diese Seite anzuzeigen oder zu lesen.",
            "JavaScript ist deaktiviert. Diese Seite benötigt JavaScript.",
        ],
        "placeholder": ["Ihr Text hier", "Hier steht Ihr Text", "Text hier einfügen", "Überschrift hier eingeben", "Platzhalter", "Inhalt folgt in Kürze"],
    },
    "fr": {
        "error": [
            "Page introuvable", "Page non trouvée", "Erreur: page introuvable", "Erreur interne du serveur",
            "La page demandée est introuvable ou n'existe plus.",
            "Il n'y a rien ou plus rien à cette adresse.",
            "Une erreur est survenue ou s'est produite.",
            "Votre demande n'a pas pu être traitée ou n'a pas abouti.",
            "Veuillez réessayer plus tard.",
            "Le site est en maintenance, de retour dans quelques minutes.",
            "Ce contenu est indisponible pour le moment.",
            "La page a été déplacée ou supprimée.",
        ],
        "access": [
            "Accès refusé", "Accès refusé. Référence", "Chargement", "Chargement en cours",
            "Chargement en cours, veuillez patienter.",
            "Vous n'avez pas l'autorisation d'accéder à cette page.",
            "Veuillez confirmer que vous n'êtes pas un robot.",
            "Votre session a expiré. Veuillez vous reconnecter.",
            "Trop de requêtes. Veuillez patienter quelques secondes.",
        ],
        "script": [
            "Veuillez activer JavaScript dans votre navigateur.",
            "Activez JavaScript pour lire ou afficher cette page.",
            "JavaScript est désactivé. Ce site nécessite JavaScript.",
        ],
        "placeholder": ["Votre texte ici", "Insérez votre texte ici", "Titre de la page ici", "Texte à venir", "Contenu à venir"],
    },
    "es": {
        "error": [
            "Página no encontrada", "Error: página no encontrada", "No encontrado", "Error interno del servidor",
            "La página solicitada no existe o no se ha encontrado.",
            "Ya no hay nada en esta dirección.",
            "Ha ocurrido un error.",
            "Se ha producido un error inesperado.",
            "Su solicitud no se pudo completar o procesar.",
            "Vuelva a intentarlo más tarde.",
            "El sitio está en mantenimiento, vuelva en unos minutos.",
            "Este contenido no está disponible en este momento.",
            "La página ha sido movida o eliminada.",
        ],
        "access": [
            "Acceso denegado", "Acceso denegado. Referencia", "Cargando",
            "Cargando, espere por favor.",
            "No tiene permiso para acceder a esta página.",
            "Confirme que no es un robot.",
            "Su sesión ha caducado. Inicie sesión de nuevo.",
            "Demasiadas solicitudes. Espere unos segundos.",
        ],
        "script": [
            "Por favor, active JavaScript en su navegador.",
            "Active JavaScript para leer o ver esta página.",
            "JavaScript está desactivado. Este sitio requiere JavaScript.",
        ],
        "placeholder": ["Su texto aquí", "Inserte su texto aquí", "Título de la página aquí", "Contenido próximamente", "Texto por añadir"],
    },
}
#: Words of the filler exemplars that are also words of a living language (en, de, fr, es, it, pt, nl).
LIVING = frozenset(
    "ac ad ante culpa do dolor dolore dui ea eros esse est et eu ex habitant id in integer labore lacinia leo magna massa morbi non nulla odio officia ornare primis qui quis sed sint sit ut vel vestibulum vitae".split()
)
#: Words of little meaning by which no message is told.
STOPWORDS = frozenset(
    (
        "a an and any are as at be been by can do does for from has have if in is it its may more no not of on one or our so some that the this to under up was we were will with you your "
        "aber als am an auf aus das dass dem den der des die dies diese dieser ein eine einem einen einer er es fur gerade hat hier ich ihr ihre ihrem im in ist kein keine mehr mit nach nicht noch nur oder sich sie sind um und uns unter von war wir wird wurde wurden zu zum zur "
        "au aux avec ce ces cette d dans de des deux du elle en est et il ils l la le les leur lui mais n ne nous ou par pas plus pour qu que qui s sa se son sont sur un une votre vous y "
        "al algo como con cuando de del el ella en es esta este esto ha hay la las lo los mas mi no o para pero por que se ser si sin su sus un una unos y ya"
    ).split()
)
