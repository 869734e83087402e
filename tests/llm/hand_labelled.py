"""Short documents labelled by hand, in wordings of their own. TEXTS were in view when the threshold, the decay and the last seeds
were chosen; FRESH were written after that, and nothing was changed with them in view."""

CLEAN = [
    "Buy milk and eggs.", "Karl prefers tea.", "La reunión es el lunes.", "Dentist at nine.", "Grandma's birthday cake: two layers, lemon.", "Wifi in the cabin was slow but fine.", "Der Schlüssel liegt unter der Matte.", "Train leaves from platform 4.",
    "Maria moved to Lisbon in March.", "On a fini le puzzle hier soir.", "The cat sleeps on the printer.", "Passport renewal costs 70 euros.", "He hates Mondays!", "Wir haben die Heizung entlüftet.", "Soccer practice got moved to the gym.", "Tengo que regar las plantas.",
    "Sold the couch for $120.", "Key takeaways: ship early, test often.", "Mon vélo a un pneu crevé.", "Blood type: 0 negative", "Priya's new number ends in 42.", "Nobody ate the soup.", "Return library books by the 12th.", "Das Konzert war ausverkauft.",
    "Our wedding photographer cancelled.", "Yesterday the payroll site was down for an hour, so Lena paid people by hand.", "Told support that the login screen kept timing out on my phone.", "Use {curly} braces sparingly, says the style guide, but `{{x}}` is right here.", "My review of the error page redesign: nice colours.",
    "Ivan's talk on HTTP 404 pages was packed.", "Ordered [blue] paint instead of [grey].", "Flight BA_204_X boards at gate 7.", "The vector [1, 2, 3] has length three.", "Follow @harbour_news and tag it #fleet.", "Two of the five servers were moved to Oslo.",
]
SLOT = [
    "Hi [Customer Name], we have received your parcel.", "Hello <<first_name>>, welcome aboard!", "Yours sincerely, @@NAME@@", "Please forward this to XX_OWNER_XX before the audit.", "Your flight from ((departure city)) is confirmed.", "Greetings {FirstName}! Your trial ends soon.", "Report for [Quarter] [Year]",
    "The contract between ||PARTY_A|| and the landlord starts in May.", "Guten Tag Frau [Nachname], anbei die Rechnung.", "Estimado [nombre del cliente]: gracias por su compra.", "Cher %%PRENOM%%, votre colis est en route.", "Call us at {{support.phone}} any time.", "Total due: ${invoice.total}", "Prepared by ##author_name##",
    "Hi *|FNAME|*, here is your digest.", "We met <Contact Person> in the lobby.", "Dear Mr. {last-name}, your seat is 12A.", "This agreement is governed by the laws of [STATE].", "Delivery on {{ delivery_date | default }} between 9 and 12.", "Signed: __SIGNATORY__",
]
FILLER = [
    "Lorem ipsum dolor sit amet, vel illum dolore eu feugiat nulla facilisis.", "Duis autem vel eum iriure dolor in hendrerit in vulputate velit esse.", "Placeholder copy, to be replaced by marketing.", "Your headline goes here.", "foo foo foo foo foo foo foo", "Owner: TBD\nDeadline: TBD\nBudget: TBD", "Some dummy text to show the layout.", "Hier kommt noch Text hin, Blindtext.",
]
NOTICE = [
    "Hmm. We're having trouble finding that site.", "The file you are looking for has been removed or renamed.", "This video is unavailable.", "429: slow down, too many requests.", "Gateway timeout while contacting the upstream host.", "You need permission to open this document. Request access or sign in with another account.", "Your account has been logged out due to inactivity.",
    "We can't connect to the server at the moment.", "Scripts are blocked. Allow JavaScript and refresh this page.", "To use this application, turn on JavaScript in your browser's settings.", "Scheduled maintenance in progress. We will be back online soon.", "An internal error occurred. Please try again in a few minutes.", "Leider ist diese Seite momentan nicht erreichbar.",
    "Vous devez vous connecter pour accéder à cette page.", "Lo sentimos, la página que busca ya no existe.", "This service has been temporarily suspended.", "Please complete the security check to access this website.", "Cookies are turned off. Please enable cookies to log in.", "500 - Something broke on our side.", "The requested URL was not found on this server.",
]
TEXTS = [(t, k) for k, ts in ((None, CLEAN), ("slot", SLOT), ("filler", FILLER), ("notice", NOTICE)) for t in ts]

FRESH = [(t, None) for t in (
    "Tomatoes need staking before July.", "Anna's brother plays the cello.", "Rent went up by 40 euros.", "Saturday: hike, then pizza.", "Der Hund frisst kein Trockenfutter.", "Le chat a encore cassé un vase.", "El examen fue más fácil de lo esperado.", "Room 214 has the good projector.", "We lost the match 3:1.", "Umbrella is in the trunk.",
    "Old router sold, new one arrives Tuesday.", "Interview notes: calm, curious, bit late.", "Wasser im Keller, Klempner kommt um acht.", "Ordering from the north depot takes a week.", "Sam thinks the budget is too tight.", "Paint colour for the hall: sage.", "My login broke twice last month and IT reset it each time.",
    "The museum was closed, so we went to the zoo.", "Chapter 3 explains cookies and how browsers store them.", "The (second) draft is better.", "Table 4 [right] lists the ports.", "x = [3, 5, 8] in the example.", "Jorge is out of office this week.", "Two lines in the log mention a timeout, nothing else.", "Nur noch zwei Tage bis zum Urlaub!")]
FRESH += [(t, "slot") for t in (
    "Thank you {guest_name}, see you on {check_in}.", "Hello [First Name] [Last Name],", "This letter confirms that <<employee>> starts on Monday.", "Kind regards, %SENDER%", "{{#if user}} Hi {{user.name}} {{/if}}", "Sehr geehrte Frau {{nachname}}, wir freuen uns.", "Invoice no. [INVOICE NUMBER] is overdue.", "Sent to @@EMAIL@@ yesterday.",
    "Bonjour [Prénom], votre rendez-vous est confirmé.", "${user} has shared a folder with you.", "The tenant, [Tenant], agrees to pay.", "Your code is <%= code %>.", "We look forward to seeing you at {VENUE}.", "# Minutes of [Project Name]", "Hola {nombre}, bienvenido.")]
FRESH += [(t, "filler") for t in ("Lorem ipsum dolor sit amet, etiam vitae nisi at sapien.", "Author: TBD\nReviewer: TBD\nLink: n/a", "Text coming soon.", "lorem lorem lorem lorem lorem lorem", "Sample paragraph, replace me.", "Add a short summary here.")]
FRESH += [(t, "notice") for t in (
    "Page not found. Check the URL and try again.", "Our website is down for planned maintenance.", "Please log in to read this article.", "JavaScript must be enabled in order to use this site.", "503 Service Unavailable", "Sorry, you have been blocked.", "Your session timed out. Sign in again.", "This page isn't working right now.",
    "Error: connection refused by the server.", "Diese Seite existiert leider nicht mehr.", "Erreur 404 : cette page est introuvable.", "Esta página requiere que inicie sesión.", "Access to this page has been denied.", "We're sorry, but something went wrong on our end.", "The server encountered an internal error.")]
