from atlasq.sources import java

CONTROLLER = '''
package a; // @GetMapping("/no")
@RestController @RequestMapping("/api")
class A {
  /* @PostMapping("/no") */
  @GetMapping("/x/{id}") Item get(@RequestParam("q") String q, @RequestParam int page) { Thread.sleep(5); return rest; }
  @RequestMapping(value = {"/y", "/z"}, method = RequestMethod.POST) void post() { restTemplate.getForObject("http://b/v1/" + "items", String.class); restTemplate.exchange(url, HttpMethod.PUT, null); }
  void flow() { client.get().uri("/w?x=1").retrieve(); kafkaTemplate.send("orders", new Order(1)); kafkaTemplate.send(name + ".x", v); }
  @KafkaListener(topics = {"paid", "sent"}) void on(@Payload Event e) { synchronized (this) {} }
  public static void main(String[] a) { SpringApplication.run(A.class, a); }
}
@Document(collection = "items") class Item {}
'''


def test_facts():
    found = list(java.facts_of("A.java", CONTROLLER))
    ends = {(f[1], f[2], f[3], f[5]) for f in found}
    assert ends == {
        ("rest", "serve", "GET /api/x/{id}?q&page", "spring-mvc"), ("rest", "serve", "POST /api/y", "spring-mvc"), ("rest", "serve", "POST /api/z", "spring-mvc"),
        ("rest", "call", "GET /v1/items", "resttemplate"), ("rest", "call", "PUT <dynamic>", "resttemplate"), ("rest", "call", "GET /w", "webclient"),
        ("kafka", "produce", "orders", "kafka"), ("kafka", "produce", "<dynamic>", "kafka"), ("kafka", "consume", "paid", "spring-kafka"), ("kafka", "consume", "sent", "spring-kafka"),
        ("blocking", None, None, "sleep"), ("blocking", None, None, "synchronized"), ("entry", None, None, "spring-boot"), ("collection", None, "items", "mongodb"),
    }
    by = {f[3]: f for f in found}
    assert by["orders"][9] == "Order" and by["paid"][9] == "Event" and by["GET /api/x/{id}?q&page"][6] == 6


def test_endpoints(spark):
    texts = spark.createDataFrame([("A.java", CONTROLLER), ("B.txt", CONTROLLER), ("C.java", None)], "path string, text string")
    out = java.endpoints(java.facts(texts), "svc")
    assert out.count() == 10 and {r["system"] for r in out.collect()} == {"svc"} and all(len(r["id"]) == 16 for r in out.collect())
